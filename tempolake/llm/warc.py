"""A content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records by a join."""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, released, shared_dir

#: Payloads of fewer bytes never become revisits.
LEAST_BYTES = 100
#: Digests that a task remembers; a payload that comes again later is sent again.
REMEMBERED = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_FIELDS = "page_id long, record_type string, header binary, digest string"


def _header(date: str) -> Column:
    """The exact header of a record, to and with the blank line. CR, LF and blanks in a URL are percent-encoded."""
    url = F.col("url")
    for c, as_hex in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(c), F.lit(as_hex))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("record_type") == "revisit"
    empty = F.lit("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), empty), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(empty),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")), F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes ``path``/headers (a row for each row of ``pages``) and ``path``/payloads (a row for each distinct payload).

    Of equal payloads of ``least_bytes`` or more the record of smallest id is the response and the others revisit it;
    rows that share that smallest id are all responses; a null id comes last, and is a response where no other is there.
    Null bodies are empty payloads; null URLs give no target field. An empty table makes an empty archive. Equality is
    by SHA-256, held against a second digest and the length of every copy before anything is written.
    """
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(body_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    ids = rows.select("page_id", "url", "digest", "bytes")
    check = F.struct(F.xxhash64("payload"), "bytes")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.min(check).alias("lo"), F.max(check).alias("hi"))
    firsts = firsts.select("digest", F.when(F.col("lo") == F.col("hi"), F.col("first")).otherwise(F.raise_error(F.concat(F.lit("different payloads under digest "), "digest"))).alias("first"))
    kind = F.when((F.col("bytes") < least_bytes) | F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    heads = ids.join(firsts, "digest").withColumn("record_type", kind)
    heads.select("page_id", "record_type", _header(date).alias("header"), "digest").write.mode("overwrite").parquet(f"{path}/headers")
    # equal digests are equal bytes, so any copy will do: a task sends each payload once, under zstd
    once = _once(rows.select("digest", "payload")).groupBy("digest").agg(F.first("packed").alias("packed"))
    _unpacked(once).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def _once(rows: DataFrame) -> DataFrame:
    """(digest, packed): each payload of a task once, as far as the task remembers."""

    def run(batches):
        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for b in batches:
            out = []
            for digest, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    out.append((digest, pack(payload.as_buffer())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], names=["digest", "packed"])

    return rows.mapInArrow(released(run), "digest string, packed binary")


def _unpacked(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstandard.decompress(z) for z in b.column(1).to_pylist()], pa.binary())], names=["digest", "payload"])

    return rows.mapInArrow(released(run), "digest string, payload binary")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of an archive; a payload that doesn't have its digest raises an error."""
    heads = spark.read.schema(HEAD_FIELDS).parquet(f"{path}/headers")
    blobs = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")))
    return heads, blobs.select("digest", whole.alias("payload"))


def reconstruct(heads: DataFrame, blobs: DataFrame) -> DataFrame:
    """(page_id, record): the original record bytes, headers and payload joined; all of them in a row are a WARC file."""
    tail = F.lit(b"\r\n\r\n")
    again = heads.where("record_type = 'revisit'").select("page_id", F.concat("header", tail).alias("record"))
    return heads.where("record_type <> 'revisit'").join(blobs, "digest").select("page_id", F.concat("header", "payload", tail).alias("record")).union(again)


def field(record: Column, name: str) -> Column:
    """A field of a record's header, null where it has none."""
    head = F.split_part(F.decode(record, "ISO-8859-1"), F.lit("\r\n\r\n"), F.lit(1))
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from the archive at ``path``.

    Sizes and digests are those of the stored bytes; a revisit's are those of the payload that it refers to.
    """
    heads, blobs = read_archive(spark, path)
    facts = blobs.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    urn = lambda name: F.nullif(F.regexp_extract(field(F.col("header"), name), "^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")
    rows = heads.select(urn("WARC-Record-ID").alias("page_id"), field(F.col("header"), "WARC-Type").alias("record_type"), urn("WARC-Refers-To").alias("refers_to"), F.substring(field(F.col("header"), "WARC-Payload-Digest"), 8, 64).alias("digest"))
    return rows.join(facts, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes an archive of ``pages`` in the shared folder and returns its ``summary``."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return summary(spark, path)


def parse(data: bytes):
    """(header bytes, block bytes) of each record of a WARC file's bytes, gzipped by record or as a whole, or plain."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        head, size = line, 0
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            head += line
            if line.lower().startswith(b"content-length:"):
                size = int(line.partition(b":")[2])
        yield head + line, f.read(size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, block) for each record of the WARC files under ``path``, whatever wrote them."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(name, h, b) for h, b in parse(data)], columns=["file", "header", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, header binary, block binary")

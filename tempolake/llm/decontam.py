"""Benchmark decontamination over a distributed positional inverted index.

The index is split by document: a row holds the postings of a run of documents, every token of theirs with its
positions. A phrase lies in one document, so its postings lists are intersected where they are stored, rarest term
first, and no list is ever moved.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, released, stored, text_key

WINDOW = 10
#: Documents and tokens of a row of the index.
SHARD_DOCS, SHARD_TOKENS = 2048, 300_000
#: Windows that are broadcast at once (at most 10 words each); more go in further rounds.
BLOCK_WINDOWS = 100_000

# Everything but digits, lower-case letters and bytes of non-ASCII characters parts words.
_APART = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_APART).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows (shard, ids, sizes, terms, ends, positions) of all tokens of all documents; ids are long or binary.

    ``terms`` are a row's distinct tokens, space-joined; the postings of the k-th are the int32 ``positions`` up to its
    int32 ``ends``. Positions count through the row's documents with one left free between two documents.
    """
    prepare(docs.sparkSession)
    names = ["shard", "ids", "sizes", "terms", "ends", "positions"]
    own = docs.schema[id_col].dataType.simpleString() == "binary"
    kind, ids_of = (pa.binary() if own else pa.int64()), F.col(id_col) if own else F.col(id_col).cast("long")

    def row(shard, ids, sizes, tokens):
        seen: dict[bytes, int] = {}
        term = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int32, len(tokens))
        where = np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(seen)))
        cols = [pa.array([shard]), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (b" ".join(seen), ends.astype("<i4").tobytes(), where[order].astype("<i4").tobytes()))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        ids, sizes, tokens, shard = [], [], [], TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                ids.append(i)
                sizes.append(len(w))
                tokens += w
                if len(ids) >= SHARD_DOCS or len(tokens) >= SHARD_TOKENS:
                    yield row(shard, ids, sizes, tokens)
                    ids, sizes, tokens, shard = [], [], [], shard + 1
        if ids:
            yield row(shard, ids, sizes, tokens)

    return docs.select(ids_of, F.col(text_col).cast("string")).mapInArrow(released(run), f"shard long, ids array<{'binary' if own else 'long'}>, sizes array<long>, terms binary, ends binary, positions binary")


class Postings:
    """A row of the index, opened."""

    def __init__(self, ids, sizes, terms: bytes, ends: bytes, positions: bytes):
        self.ids, self.sizes = ids, np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.term = {w: k for k, w in enumerate(terms.split(b" "))} if terms else {}
        self.ends = np.concatenate(([0], np.frombuffer(ends, "<i4"))).astype(np.int64)
        self.positions = np.frombuffer(positions, "<i4")

    def of(self, k: int) -> np.ndarray:
        return self.positions[self.ends[k] : self.ends[k + 1]]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase: the rarest term's list, offset, intersected with the next rarest, and so on."""
        offsets = np.argsort(self.ends[terms + 1] - self.ends[terms], kind="stable")
        at = None
        for o in offsets:
            found = self.of(int(terms[o])) - o
            if at is None:
                at = found
            else:
                k = np.searchsorted(found, at)
                k[k == len(found)] = 0
                at = at[found[k] == at]
            if not len(at):
                break
        return at

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term that have every term of ``terms`` at most ``span`` tokens off, in one document."""
        offsets = np.argsort(self.ends[terms + 1] - self.ends[terms], kind="stable")
        at = self.of(int(terms[offsets[0]]))
        for o in offsets[1:]:
            p = self.of(int(terms[o]))
            k = np.searchsorted(p, at)
            ok = np.zeros(len(at), bool)
            for side in (np.clip(k, 0, len(p) - 1), np.clip(k - 1, 0, len(p) - 1)):
                ok |= (np.abs(p[side] - at) <= span) & (self.doc(p[side]) == self.doc(at))
            at = at[ok]
            if not len(at):
                break
        return at


def window_blocks(items, window: int = WINDOW, block: int = BLOCK_WINDOWS):
    """(terms, matrix of term numbers padded with -1, item of each window) for blocks of the windows of (id, text) rows."""

    def windows():
        for i, t in items:
            found = words(t)
            for k in range(max(1, len(found) - window + 1) if found else 0):
                yield i, found[k : k + window]

    each = windows()
    while rows := list(itertools.islice(each, block)):
        terms: dict[bytes, int] = {}
        matrix = np.full((len(rows), window), -1, np.int32)
        for r, (_, w) in enumerate(rows):
            matrix[r, : len(w)] = [terms.setdefault(x, len(terms)) for x in w]
        yield list(terms), matrix, [i for i, _ in rows]


def search(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, span: int | None = None) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, near array<string>) for every document of the index.

    ``items`` are those with a window that occurs in the document as an exact phrase, ``n_hit`` the words inside any such
    occurrence. With ``span``, ``near`` lists items that have all terms of a window within ``span`` tokens of its rarest
    term (proximity); else it is empty. Items come in blocks of at most ``BLOCK_WINDOWS`` windows; one block at a time is
    at the driver and broadcast, every index row meets it, and what it hits is stored before the next. Items of null id
    count for ``n_hit`` but are not listed.
    """
    sc = index.sparkSession.sparkContext
    items = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    found = None
    for block in window_blocks(items, window):
        sent = sc.broadcast(block)
        hits = stored(_hits(index, sent, span), "hits")
        sent.destroy()
        found = hits if found is None else found.union(hits)
    docs = index.select("shard", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "z")).select("shard", "doc", "z.ids", "z.sizes")
    none = F.array().cast("array<string>")
    if found is None:
        return docs.select(F.col("ids").alias("id"), F.col("sizes").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("near"))
    each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("shard", "doc").agg(each("spans").alias("spans"), each("items").alias("items"), each("near").alias("near"))
    # words of spans in order: what a span has beyond the end of those before it
    grown = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda x, s: F.struct(F.greatest(x["end"], s["end"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(x["end"], s["start"]))).alias("n")),
    )
    found = found.select("shard", "doc", grown["n"].alias("n_hit"), "items", "near")
    out = docs.join(found, ["shard", "doc"], "left")
    return out.select(F.col("ids").alias("id"), F.col("sizes").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def _hits(index: DataFrame, block, span: int | None) -> DataFrame:
    """(shard, doc, spans, items, near) of the documents that a block's windows hit; spans are apart and in order."""

    def shard(number: int, p: Postings):
        inside = np.zeros(int(p.sizes.sum()) + len(p.sizes) + 1, np.int32)
        exact: set[tuple[int, str]] = set()
        close: set[tuple[int, str]] = set()
        terms, matrix, items = block.value
        local = np.array([*(p.term.get(t, -1) for t in terms), -2], np.int64)
        here = local[matrix]
        for r in np.flatnonzero((here != -1).all(1)):
            k = here[r][here[r] >= 0]
            at = p.phrase(k) if len(k) else k
            np.add.at(inside, at, 1)
            np.add.at(inside, at + len(k), -1)
            if items[r] is not None:
                exact |= {(int(d), items[r]) for d in np.unique(p.doc(at))}
                if span is not None:
                    close |= {(int(d), items[r]) for d in p.doc(p.near(k, span))}
        covered = np.diff(np.concatenate(([0], (np.cumsum(inside) > 0).astype(np.int8))))
        start, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        docs: dict[int, tuple[list, list, list]] = {}
        for a, e, d in zip(start.tolist(), end.tolist(), p.doc(start).tolist(), strict=True):
            docs.setdefault(d, ([], [], []))[0].append({"start": a - int(p.starts[d]), "end": e - int(p.starts[d])})
        for k, pairs in ((1, exact), (2, close)):
            for d, i in pairs:
                docs.setdefault(d, ([], [], []))[k].append(i)
        return [{"shard": number, "doc": d, "spans": x, "items": y, "near": z} for d, (x, y, z) in docs.items()]

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                number, *rest = (b.column(k)[r].as_py() for k in range(6))
                if out := shard(number, Postings(*rest)):
                    yield pa.RecordBatch.from_pylist(out, schema=_HITS)

    return index.mapInArrow(released(run), "shard long, doc int, spans array<struct<start:int,end:int>>, items array<string>, near array<string>")


_HITS = pa.schema([("shard", pa.int64()), ("doc", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, span: int | None = None) -> DataFrame:
    """``search`` over the stored index of ``docs``: one row for each row of ``docs``.

    Null and empty texts have no words and no hits; repeated rows and repeated or null ids stay, each judged on its own
    text. Empty tables give no rows or no hits. Other columns are not read. The index is a table in the shared folder.
    """
    return search(stored(build_index(docs, id_col, text_col), "postings"), benchmark, window=window, span=span)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with no word inside a benchmark window, as they are; rows of one id are told apart by text.

    Null and empty texts have no words and stay; repeated rows go or stay together; null ids are like any other. Of an
    empty table, or with an empty benchmark, all rows stay.
    """
    key = fresh("__key", docs.columns)
    keyed = docs.withColumn(key, text_key(id_col, text_col))
    found = decontaminate(keyed.select(key, text_col), benchmark, key, text_col, window)
    return keyed.join(found.where("n_hit > 0").select(F.col("id").alias(key)).distinct(), key, "left_anti").select(docs.columns)

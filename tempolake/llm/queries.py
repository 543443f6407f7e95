"""The registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bcr_dedup, chat, decontam, embedding_pq, line_dedup, packing, quality_mil, simhash, toxicity_cnn, warc
from .common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))
), h AS (SELECT DISTINCT doc_id, item_id, k, n FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


#: A conversation that every run of op10 has besides the table's: control strings inside both texts.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.union(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))))


QUERIES = {"op1_simhash": op1_simhash, "op5_packing": op5_packing, "op6_warc": op6_warc, "op7_decontamination": op7_decontamination, "op10_chat": op10_chat}
ORACLES = {"op6_warc": OP6_SQL, "op7_decontamination": OP7_SQL}


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_mil.crc_fold("doc_id", 4)
    found = quality_mil.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=fold != 2)
    return found.select(F.col("id").alias("doc_id"), (quality_mil.crc_fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality_mil.CUT).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_mil.crc_fold("doc_id", 5)
    found = toxicity_cnn.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=fold != 0)
    return found.select(F.col("id").alias("doc_id"), (quality_mil.crc_fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES |= {"op2_quality": op2_quality, "op3_toxicity": op3_toxicity}


def op4_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pq.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), characters=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_bcr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bcr_dedup.dedup_bytes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
b AS (SELECT doc_id, n, b, substr(h, 2 * b + 1, 1222) AS part FROM (SELECT doc_id, h, n, unnest(range(0, greatest(n - 99, 0), 512)) AS b FROM t)),
w AS (SELECT doc_id, b + i AS start, md5(substr(part, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, b, part, unnest(range(0, least(512, n - 99 - b))) AS i FROM b)),
r AS (SELECT doc_id, start FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, start) > 1),
j AS (SELECT doc_id, start, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > 100, true) AS new FROM r),
s AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS e FROM (SELECT doc_id, start, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM j) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
g AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM p JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""

ORACLES |= {"op4_embedding_pq": OP4_SQL, "op9_bcr_dedup": OP9_SQL}
QUERIES |= {"op4_embedding_pq": op4_embedding_pq, "op8_line_dedup": op8_line_dedup, "op9_bcr_dedup": op9_bcr_dedup}

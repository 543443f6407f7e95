"""Losses, retrieval, similarity and graph shapes over the event, text, vector and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chess
from ..operators import evaluation, loss, query_sets, retrieval, similarity
from .catalog import query
from .relational_queries import table

LOSS_SQL = """
e AS (SELECT user_id, event_type, ts, greatest(-1000, least(1000, value - 100)) AS before FROM events),
l AS (SELECT *, lead(before) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS ply FROM e),
m AS (SELECT *, CASE WHEN nxt IS NULL THEN NULL ELSE greatest(0, before + nxt) END AS loss FROM l)
"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "events").withColumn("ply", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    return loss.lead_loss(moves, "user_id", ["ts"], F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.col("value") - 100)))


@query(f"""
WITH {LOSS_SQL} SELECT CASE WHEN loss IS NULL THEN 'unknown' WHEN loss >= 300 THEN 'blunder' WHEN loss >= 100 THEN 'mistake' WHEN loss >= 50 THEN 'inaccuracy' ELSE 'ok' END AS judgment,
count(*) AS n, round(sum(loss), 2) AS total FROM m GROUP BY ALL
""")
def lead_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).groupBy(chess.classify_loss(F.col("loss")).alias("judgment")).agg(F.count("*").alias("n"), F.round(F.sum("loss"), 2).alias("total"))


@query(f"WITH {LOSS_SQL} SELECT event_type, round(coalesce(avg(loss), 0), 4) AS acpl, count(*) AS n FROM m WHERE ply >= 8 GROUP BY event_type")
def acpl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).where("ply >= 8").groupBy("event_type").agg(F.round(F.coalesce(F.avg("loss"), F.lit(0.0)), 4).alias("acpl"), F.count("*").alias("n"))


@query("SELECT event_type, round(avg(1 / (1 + exp(-0.00368208 * value))), 6) AS win FROM events GROUP BY event_type")
def win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(chess.win_probability(F.col("value"))), 6).alias("win"))


BM25_SQL = """
d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT term, doc_id, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT qid, doc_id, round(sum(times * greatest(1e-6, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id), s GROUP BY ALL),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid"), k)


@query(f"WITH {BM25_SQL} SELECT qid, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10)


DENSE_SQL = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings), u AS (SELECT vec_id, label, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS e FROM v),
s AS (SELECT q.vec_id AS qid, q.label AS qlabel, d.vec_id, d.label, round(list_dot_product(q.e, d.e), 6) AS score FROM u q, u d WHERE q.vec_id % 100 = 0),
ds AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries); the queries are the vectors whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("qlabel"))


def _dense(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, queries, hits)."""
    v, q = _vectors(spark, sf_dir)
    return v, q, retrieval.dense_topk(v, q, k)


@query(f"WITH {DENSE_SQL} SELECT qid, vec_id, score, rank FROM ds WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 10)[2]


@query(f"""
WITH {DENSE_SQL}, nl AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ds WHERE label <> qlabel),
f AS (SELECT qid, vec_id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(src, ',' ORDER BY src) AS sources
      FROM (SELECT qid, vec_id, rank, 'all' AS src FROM ds WHERE rank <= 30 UNION ALL SELECT qid, vec_id, rank, 'other' FROM nl WHERE rank <= 30) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM f QUALIFY rank <= 10
""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    near = lambda asked, k: retrieval.dense_topk(v, asked, k)
    far = lambda asked, k: retrieval.dense_topk(v, asked, k, differ=("label", "qlabel"))
    return query_sets.hybrid(q, {"all": near, "other": far}, 10, 30, doc_id="vec_id").select("qid", "vec_id", "score", "sources", "rank")


METRIC_SQL = f"""
{DENSE_SQL}, h AS (SELECT * FROM ds WHERE rank <= 10), nr AS (SELECT qid, count(*) AS n_relevant FROM s WHERE label = qlabel GROUP BY qid),
mm AS (SELECT qid, any_value(qlabel) AS qlabel, count(*) FILTER (label = qlabel) AS found, min(rank) FILTER (label = qlabel) AS first,
              coalesce(sum(1 / log2(rank + 1)) FILTER (label = qlabel), 0) AS dcg FROM h GROUP BY qid),
me AS (SELECT qid, qlabel, n_relevant, found / n_relevant AS recall, found / 10 AS precision, coalesce(1 / first, 0) AS rr, CAST(found > 0 AS INT) AS hit,
              dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM mm JOIN nr USING (qid))
"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q, hits = _dense(spark, sf_dir, 10)
    return evaluation.class_metrics(q, hits, v, "qlabel", "label", 10, "qid", "vec_id").join(q.select("qid", "qlabel"), "qid")


@query(f"WITH {METRIC_SQL} SELECT qid, n_relevant, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr, hit, round(ndcg, 6) AS ndcg FROM me")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("qid", "n_relevant", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr")), "hit", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {METRIC_SQL} SELECT coalesce(CAST(qlabel AS VARCHAR), 'all') AS family, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM me GROUP BY ROLLUP (qlabel)")
def ir_metrics_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _metrics(spark, sf_dir).rollup("qlabel").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg"))))
    return out.select(F.coalesce(F.col("qlabel").cast("string"), F.lit("all")).alias("family"), "n", "recall", "mrr", "ndcg")


@query(f"""
WITH {DENSE_SQL}, u2 AS (SELECT vec_id, label, list_transform(raw[1:8], lambda x: x / sqrt(list_dot_product(raw[1:8], raw[1:8]))) AS e FROM v),
s2 AS (SELECT q.vec_id AS qid, q.label AS qlabel, d.vec_id, d.label, round(list_dot_product(q.e, d.e), 6) AS score FROM u2 q, u2 d WHERE q.vec_id % 100 = 0),
ds2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s2),
h AS (SELECT 'whole' AS retriever, * FROM ds WHERE rank <= 20 UNION ALL SELECT 'short', * FROM ds2 WHERE rank <= 20),
nr AS (SELECT qid, count(*) AS n_relevant FROM s WHERE label = qlabel GROUP BY qid),
per AS (SELECT retriever, qid, any_value(qlabel) AS family, coalesce(1 / min(rank) FILTER (label = qlabel), 0) AS mrr,
  {", ".join(f"count(*) FILTER (label = qlabel AND rank <= {k}) / any_value(n_relevant) AS recall_{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (label = qlabel AND rank <= {k}), 0) / list_sum(list_transform(range(1, least(any_value(n_relevant), {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}" for k in (1, 5, 10, 20))},
  count(*) FILTER (label = qlabel AND rank <= 10) / 10 AS precision_10, CAST(count(*) FILTER (label = qlabel AND rank <= 10) > 0 AS INT) AS hit_10 FROM h JOIN nr USING (qid) GROUP BY retriever, qid)
SELECT retriever, coalesce(CAST(family AS VARCHAR), 'all') AS family, count(*) AS n, CAST(0 AS BIGINT) AS empty, round(avg(mrr), 6) AS mrr,
  {", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}, round(avg(ndcg_{k}), 6) AS ndcg_{k}" for k in (1, 5, 10, 20))}, round(avg(precision_10), 6) AS precision_10, round(avg(hit_10), 6) AS hit_10
FROM per GROUP BY GROUPING SETS ((retriever, family), (retriever))
""")
def compare_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    short = v.withColumn("embedding", F.slice("embedding", 1, 8))
    asked = lambda x: x.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").cast("string").alias("family"))
    q = asked(v)
    classes = v.select("vec_id", F.col("label").cast("string").alias("family"))
    found = query_sets.compare(q, classes, {"whole": retrieval.dense_topk(v, q, 20), "short": retrieval.dense_topk(short, asked(short), 20)}, doc_id="vec_id", by_family=True)
    return found.select("retriever", "family", "n", "empty", *(F.round(c, 6).alias(c) for c in found.columns[4:]))


@query(f"""
WITH {DENSE_SQL}, p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS base FROM embeddings GROUP BY label),
t AS (SELECT qlabel AS label, avg(CASE WHEN label = qlabel THEN 1.0 ELSE 0 END) AS top FROM ds WHERE rank <= 50 GROUP BY qlabel)
SELECT label, round(base, 6) AS base, round(top, 6) AS top, round(top / base, 6) AS lift FROM p JOIN t USING (label)
""")
def vocab_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q, hits = _dense(spark, sf_dir, 50)
    total = v.agg(F.count("*").alias("total"))  # one row
    base = v.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("label", (F.col("n") / F.col("total")).alias("base"))
    top = hits.join(q.select("qid", "qlabel"), "qid").join(v.select("vec_id", "label"), "vec_id").groupBy(F.col("qlabel").alias("label")).agg(F.avg((F.col("label") == F.col("qlabel")).cast("double")).alias("top"))
    return base.join(top, "label").select("label", F.round("base", 6).alias("base"), F.round("top", 6).alias("top"), F.round(F.col("top") / F.col("base"), 6).alias("lift"))


BITS_SQL = """
b AS (SELECT vec_id, label, list_aggregate(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END), 'bit_or') AS bits FROM embeddings),
j AS (SELECT x.label, x.vec_id AS a, y.vec_id AS c, bit_count(x.bits & y.bits) / bit_count(x.bits | y.bits) AS sim FROM b x JOIN b y ON x.label = y.label AND x.vec_id <> y.vec_id
      WHERE bit_count(x.bits & y.bits) / bit_count(x.bits | y.bits) >= 0.45)
"""


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda i: F.when(F.element_at("embedding", i + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), one), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("bits"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = similarity.jaccard(F.col("a.bits"), F.col("b.bits"))
    pairs = similarity.blocked_pairs(_bits(spark, sf_dir), "vec_id", "label", sim, sim, 0.45)
    return pairs.select(F.col("block").alias("label"), F.col("node").alias("a"), F.col("other").alias("c"), F.col("weight").alias("sim"))


@query(f"WITH {BITS_SQL} SELECT label, count(*) AS pairs, round(avg(sim), 6) AS mean, round(max(sim), 6) AS best FROM j GROUP BY label")
def bitboard_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.max("sim"), 6).alias("best"))


@query(f"""
WITH {BITS_SQL}, r AS (SELECT a, c, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, c DESC) AS k FROM j)
SELECT least(a, c) AS lo, greatest(a, c) AS hi, round(max(sim), 4) AS score FROM r WHERE k <= 5 GROUP BY ALL
""")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.bitboard_edges(_bits(spark, sf_dir), "vec_id", "label", "bits", 5, 0.45).withColumn("score", F.round("score", 4))


@query("""
WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks, max(n) AS largest, CAST(sum(n) * (sum(n) - 1) // 2 AS BIGINT) AS naive, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS blocked FROM s
""")
def blocking_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.blocking_stats(table(spark, sf_dir, "embeddings"), F.col("label"))


GRAPH_SQL = """
led AS (SELECT c_mktsegment AS opening, l_partkey AS pos, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
err AS (SELECT o_custkey AS player, l_partkey AS pos, count(*) AS n, avg(l_quantity) AS cp FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL),
shown AS (SELECT l_partkey AS pos, l_linestatus AS theme, count(*) AS n FROM lineitem GROUP BY ALL)
"""


#: Bytes of the lines' files for each part of a shuffle: sorts and groups of a task stay as small whatever the input.
PART_BYTES = 8 << 20


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts that shuffles of the lines take."""
    size = int(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def _graph(spark: SparkSession, sf_dir: str, opening: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(led, err, shown); ``led`` of one opening only where it is named."""
    parts = _parts(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("pos"), "l_returnflag", "l_linestatus", "l_quantity")
    told = lines.repartition(parts, "l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("player")), "l_orderkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("opening"))
    people = people if opening is None else people.where(F.col("opening") == opening)
    led = told.select("player", "pos").repartition(parts, "player").join(people, "player").repartition(parts, "pos").groupBy("opening", "pos").agg(F.count("*").alias("n"))
    err = told.where("l_returnflag = 'R'").select("player", "pos", "l_quantity").repartition(parts, "pos").groupBy("player", "pos").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("cp"))
    return led, err, lines.select("pos", F.col("l_linestatus").alias("theme")).repartition(parts, "pos").groupBy("pos", "theme").agg(F.count("*").alias("n"))


@query(f"""
WITH {GRAPH_SQL} SELECT player, pos, err.n AS n, round(cp, 4) AS cp, themes FROM err JOIN (SELECT pos, string_agg(theme, ',' ORDER BY theme) AS themes FROM shown GROUP BY pos) USING (pos)
WHERE pos IN (SELECT pos FROM led WHERE opening = 'BUILDING' AND n >= 2)
""")
def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    led, err, shown = _graph(spark, sf_dir)
    edge = lambda df, src, dst, rel, cp=None: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.col("n").alias("count"), (F.lit(None) if cp is None else F.col(cp)).cast("double").alias("avg_cp_loss"), F.lit(None).cast("string").alias("examples"))
    at = graph.node("position", F.col("pos").cast("string"))
    edges = edge(led, graph.node("opening", F.col("opening")), at, "leads_to").union(edge(err, graph.node("player", F.col("player").cast("string")), at, "blunders_at", "cp"))
    found = graph.mistakes_in_opening(edges.union(edge(shown, at, graph.node("theme", F.col("theme")), "exhibits")), None, "BUILDING", 2)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return found.select(number("player").alias("player"), number("dst").alias("pos"), F.col("count").alias("n"), F.round("avg_cp_loss", 4).alias("cp"), F.array_join("themes", ",").alias("themes"))


@query(f"""
WITH {GRAPH_SQL}, p AS (SELECT pos, 'opening' AS path, sum(least(n, 5) / 5) AS s FROM led WHERE opening = 'BUILDING' GROUP BY pos
  UNION ALL SELECT pos, 'player', sum(1.5 * (0.5 * least(n, 5) / 5 + 0.5 * least(cp, 600) / 600)) FROM err GROUP BY pos
  UNION ALL SELECT pos, 'theme', sum(1.2 * least(n, 3) / 3) FROM shown WHERE theme = 'F' GROUP BY pos)
SELECT pos, string_agg(path, '+' ORDER BY path) AS support, round(sum(s) + CASE WHEN count(*) > 1 THEN 3.0 * (count(*) - 1) ELSE 0 END, 6) AS score FROM p GROUP BY pos
""")
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    led, err, shown = _graph(spark, sf_dir, "BUILDING")
    edge = lambda df, src, dst, rel, **more: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.col("n").alias("count"), more.get("cp", F.lit(None)).cast("double").alias("avg_cp_loss"))
    pos = F.concat(F.lit("position:"), F.col("pos").cast("string"))
    edges = edge(led, F.col("opening"), pos, "leads_to").union(edge(err, F.lit("everyone"), pos, "blunders_at", cp=F.col("cp"))).union(edge(shown, pos, F.col("theme"), "exhibits"))
    links = spark.createDataFrame([(0, "opening", "BUILDING"), (0, "player", "everyone"), (0, "theme", "F")], "qid int, kind string, id string")
    out = graph.combine(graph.path_scores(F.broadcast(links), edges, _parts(spark, sf_dir)))  # three links
    return out.select(F.substring_index("position", ":", -1).cast("long").alias("pos"), F.array_join("support", "+").alias("support"), F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT n_nationkey AS qid, 'how does ' || lower(n_name) || ' trade in ' || lower(r_name) || ' today' AS q FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT lower(n_name) AS surface, 'player:' || lower(n_name) AS id, 'player' AS kind FROM nation UNION ALL SELECT lower(r_name), 'family:' || r_name, 'family' FROM region),
w AS (SELECT unnest(regexp_extract_all(lower(r_name), '[a-z0-9]+')) AS surface, 'family:' || r_name AS id, 'family' AS kind FROM region),
x AS (SELECT * FROM f UNION SELECT * FROM w WHERE length(surface) >= 4)
SELECT DISTINCT qid, kind, id FROM q, x WHERE CASE WHEN contains(surface, ' ') THEN contains(q, surface) ELSE list_contains(regexp_extract_all(q, '[a-z0-9]+'), surface) END
""")
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    asked = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("how does "), F.lower("n_name"), F.lit(" trade in "), F.lower("r_name"), F.lit(" today")).alias("text"))
    node = lambda df, kind, c: df.select(graph.node(kind, F.col(c)).alias("id"), F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return graph.link(asked, graph.surfaces(node(nation, "player", "n_name").union(node(region, "family", "r_name")))).select("qid", "kind", "id")


@query(f"""
WITH {GRAPH_SQL} SELECT 'edge' AS what, 'leads_to' AS name, count(*) AS n FROM led UNION ALL SELECT 'edge', 'blunders_at', count(*) FROM err UNION ALL SELECT 'edge', 'exhibits', count(*) FROM shown
UNION ALL SELECT 'node', 'player', count(DISTINCT player) FROM err UNION ALL SELECT 'node', 'position', count(DISTINCT pos) FROM shown UNION ALL SELECT 'node', 'opening', count(DISTINCT opening) FROM led
""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    led, err, shown = _graph(spark, sf_dir)
    edges = led.select(F.lit("leads_to").alias("rel")).union(err.select(F.lit("blunders_at"))).union(shown.select(F.lit("exhibits")))
    nodes = err.select("player").distinct().select(F.lit("player").alias("kind")).union(shown.select("pos").distinct().select(F.lit("position"))).union(led.select("opening").distinct().select(F.lit("opening")))
    return graph.stats(nodes, edges)


FENS = [
    ("KID", "r1bqk2r/pp2ppbp/2np1np1/8/2PNP3/2N1B3/PP3PPP/R2QKB1R w KQkq - 0 1"),
    ("FRENCH", "rnbqkbnr/pp3ppp/4p3/2pp4/3P1B2/4P3/PPP2PPP/RN1QKBNR w KQkq - 0 1"),
    ("START", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"),
    ("KPE", "8/5k2/6p1/8/8/6P1/5K2/8 w - - 0 40"),
    ("RRE", "r3k2r/ppp2ppp/2n5/8/8/2N5/PPP2PPP/R3K2R w KQkq - 0 15"),
]


@query(f"""
WITH f(id, fen) AS (VALUES {", ".join(f"('{i}', '{f}')" for i, f in FENS)}),
x AS (SELECT *, array_to_string(list_reverse(string_split({"".join("replace(" for _ in range(8))}split_part(fen, ' ', 1){"".join(f", '{n}', repeat('.', {n}))" for n in range(1, 9))}, '/')), '') AS sq FROM f),
c AS (SELECT *, length(regexp_replace(sq, '[^QRBNqrbn]', '', 'g')) AS heavy FROM x)
SELECT id, array_to_string(string_split(fen, ' ')[1:4], ' ') AS pos_key, CASE WHEN heavy <= 6 THEN 'endgame' WHEN CAST(split_part(fen, ' ', 6) AS INT) <= 12 THEN 'opening' ELSE 'middlegame' END AS phase,
  CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN sq[i + 1] = 'P' THEN CAST(1::UBIGINT << i::UBIGINT AS HUGEINT) ELSE 0 END)) AS BIGINT) AS white_pawns,
  array_to_string(list_transform(['Q', 'R', 'B', 'N', 'P'], lambda p: repeat(p, length(sq) - length(replace(sq, p, '')))), '') || '|' || array_to_string(list_transform(['q', 'r', 'b', 'n', 'p'], lambda p: repeat(upper(p), length(sq) - length(replace(sq, p, '')))), '') AS signature
FROM c
""")
def fen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fen")
    return spark.createDataFrame(FENS, "id string, fen string").select("id", chess.position_key(f).alias("pos_key"), chess.phase(f).alias("phase"), chess.bitboard(f, "P").alias("white_pawns"), chess.material_signature(f).alias("signature"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY lang")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))

"""Relational shapes: filters, joins, aggregates, windows and top-k over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chess
from ..operators import evaluation, relational
from ..sources import store
from .catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 2) AS avg_price, round(sum(l_extendedprice), 2) AS total
FROM {LINES} JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC, l_returnflag, l_linestatus LIMIT 5
""")
def weakness_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of_orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = relational.top_totals(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", 5)
    return out.select("l_returnflag", "l_linestatus", "n", F.round("mean", 2).alias("avg_price"), F.round("total", 2).alias("total"))


@query(f"""
SELECT p_brand, count(DISTINCT o_orderkey) AS orders, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n, min(p_type) AS p_type
FROM {LINES} JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P' GROUP BY p_brand HAVING count(DISTINCT o_orderkey) >= 4
ORDER BY avg_price DESC, p_brand LIMIT 10
""")
def opening_weakness_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of_orders(spark, sf_dir).where("o_orderstatus <> 'P'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = relational.worst_means(rows, "p_brand", "o_orderkey", "l_extendedprice", 4, 10, F.min("p_type").alias("p_type"))
    return out.select("p_brand", F.col("units").alias("orders"), F.round("mean", 2).alias("avg_price"), "n", "p_type")


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f_total FROM orders GROUP BY o_orderpriority
""")
def judgement_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = relational.counts_of("o_orderstatus", {k: k.lower() for k in "FOP"})
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*kinds, F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("f_total"))


@query("""
WITH g AS (SELECT l_returnflag, p_brand, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS wins FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, p_brand) AS rank FROM g QUALIFY rank <= 5
""")
def repertoire_topk_per_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = rows.groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("wins"))
    return relational.topk_per_group(out, ["l_returnflag"], [F.desc("n"), F.col("p_brand")], 5)


@query("""
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank
FROM lineitem WHERE abs(coalesce(l_quantity, 0)) <= 45 QUALIFY rank <= 3
""")
def worst_examples_per_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.abs(F.coalesce("l_quantity", F.lit(0.0))) <= 45).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return relational.topk_per_group(rows, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3)


@query("""
WITH one AS (SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= 200
             QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1)
SELECT * FROM one ORDER BY l_extendedprice DESC, l_partkey LIMIT 12
""")
def distinct_on_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 200").select("l_partkey", (-F.col("l_extendedprice")).alias("worse"), "l_orderkey", "l_linenumber")
    one = relational.distinct_on(rows, ["l_partkey"], ["worse", "l_orderkey", "l_linenumber"])
    return one.select("l_partkey", (-F.col("worse")).alias("l_extendedprice"), "l_orderkey", "l_linenumber").orderBy(F.desc("l_extendedprice"), "l_partkey").limit(12)


@query("""
WITH seen AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, n FROM part JOIN seen ON p_partkey = l_partkey WHERE n >= 40 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
""")
def semi_or_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    seen = table(spark, sf_dir, "part").select("p_partkey").join(lines.groupBy("p_partkey").agg(F.count("*").alias("n")), "p_partkey")
    return relational.with_membership(seen, lines.where("l_quantity > 49"), "p_partkey", "large").where("n >= 40 OR large").select("p_partkey", "n")


@query("SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def argmax_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = relational.best_row(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], F.col("o_totalprice"), F.col("o_orderkey"))
    return best.toDF("o_custkey", "best", "o_orderkey")


@query("""
SELECT CASE l_linestatus WHEN 'O' THEN 'F' ELSE 'O' END AS color, l_returnflag, count(*) AS games, round(avg(1.0 - l_discount), 6) AS score FROM lineitem GROUP BY ALL
""")
def opponent_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = relational.flipped("l_linestatus", "O", "F")
    return table(spark, sf_dir, "lineitem").groupBy(other.alias("color"), "l_returnflag").agg(F.count("*").alias("games"), F.round(F.avg(1.0 - F.col("l_discount")), 6).alias("score"))


@query("""
SELECT o_orderkey, max(o_totalprice) AS price, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30 GROUP BY o_orderkey
""")
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select("l_orderkey", "l_returnflag")
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderkey").agg(F.max("o_totalprice").alias("price"), relational.listed("l_returnflag").alias("flags"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%AR%' AND p_brand ILIKE 'brand%' AND (p_size > 10 OR p_type IS NULL)")
def ilike_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = relational.all_of([F.col("p_name").ilike("%AR%"), F.col("p_brand").ilike("brand%"), None, relational.any_of([F.col("p_size") > 10, F.col("p_type").isNull()])])
    return table(spark, sf_dir, "part").where(keep).select("p_partkey", "p_name", "p_brand")


@query("SELECT doc_id, lang, coalesce(toxic, -1) AS toxic, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", "lang", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.col("quality").isNull().alias("unlabelled"))


@query("SELECT doc_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.missing(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT (SELECT count(*) FROM orders) AS games, (SELECT count(*) FROM lineitem) AS moves, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS themes,
       (SELECT count(DISTINCT o_custkey) FROM orders) AS subjects
""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return store.stats(table(spark, sf_dir, "orders"), lines, lines, "o_orderkey", "o_custkey", ("l_orderkey", "l_linenumber"))


@query("SELECT p_type, coalesce(p_brand, 'all') AS p_brand, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand) HAVING p_type IS NOT NULL")
def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.count("*").alias("n")).where("p_type is not null").select("p_type", F.coalesce("p_brand", F.lit("all")).alias("p_brand"), "n")


@query("""
SELECT split_part(o_orderpriority, '-', 1) AS code, trim(split_part(p_name || ':x', ':', 1)) AS family, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of_orders(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("code"), chess.opening_family(F.concat("p_name", F.lit(":x"))).alias("family")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'garbage' ELSE (p_size * 20) || '+' || (p_size % 5) END AS tc, p_size FROM part),
s AS (SELECT tc, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 20 + 40 * (p_size % 5) END AS sec FROM c)
SELECT CASE WHEN sec IS NULL THEN NULL WHEN sec < 30 THEN 'ultrabullet' WHEN sec < 180 THEN 'bullet' WHEN sec < 480 THEN 'blitz' WHEN sec < 1500 THEN 'rapid' ELSE 'classical' END AS speed, count(*) AS n
FROM s GROUP BY ALL
""")
def speed_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.when(F.col("p_size") % 7 == 0, "garbage").otherwise(F.concat((F.col("p_size") * 20).cast("string"), F.lit("+"), (F.col("p_size") % 5).cast("string")))
    return table(spark, sf_dir, "part").groupBy(chess.speed(control).alias("speed")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT c_mktsegment, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS r,
                  count(*) OVER (PARTITION BY c_mktsegment) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, CASE WHEN n - r < greatest(1, floor(n * 0.25)) THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(o_orderdate) AS first FROM s GROUP BY ALL
""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = evaluation.temporal_split(rows.select("c_mktsegment", "o_orderkey", "o_orderdate"), ["c_mktsegment"], ["o_orderdate", "o_orderkey"])
    return out.groupBy("c_mktsegment", "split").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))


SPLIT_SQL = """
t AS (SELECT o_orderkey, l_returnflag, l_linestatus, p_brand, l_extendedprice, l_linenumber, o_orderdate < TIMESTAMP '1997-01-01' AS train
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


def _split(spark, sf_dir):
    rows = lines_of_orders(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("train", F.col("o_orderdate") < F.to_timestamp(F.lit("1997-01-01")))


@query(f"""
WITH {SPLIT_SQL}, c AS (SELECT l_returnflag, p_brand, count(*) FILTER (train) AS tr, count(*) FILTER (NOT train) AS te FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY tr DESC, p_brand) AS k FROM c),
b AS (SELECT p_brand FROM c GROUP BY p_brand ORDER BY sum(tr) DESC, p_brand LIMIT 1),
x AS (SELECT l_returnflag, sum(te) AS n_test, sum(CASE WHEN k = 1 THEN te ELSE 0 END) / sum(te) AS top1, sum(CASE WHEN k <= 3 THEN te ELSE 0 END) / sum(te) AS top3,
       sum(CASE WHEN p_brand = (SELECT p_brand FROM b) THEN te ELSE 0 END) / sum(te) AS base,
       sum(CASE WHEN p_brand IN (SELECT p_brand FROM c GROUP BY p_brand HAVING sum(tr) > 0) THEN te ELSE 0 END) / sum(te) AS coverage FROM r GROUP BY l_returnflag HAVING sum(te) > 0)
SELECT l_returnflag, CAST(n_test AS BIGINT) AS n_test, round(top1, 6) AS top1, round(top3, 6) AS top3, round(base, 6) AS base, round(top1 - base, 6) AS lift, round(coverage, 6) AS coverage FROM x
""")
def opening_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.prediction(_split(spark, sf_dir), ["l_returnflag"], "p_brand", F.col("train"))
    return out.select("l_returnflag", "n_test", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "base", "lift", "coverage")))


@query(f"""
WITH {SPLIT_SQL}, c AS (SELECT l_linenumber, p_brand, count(*) FILTER (train) * 1.0 AS a, count(*) FILTER (NOT train) * 1.0 AS b,
      coalesce(sum(l_extendedprice) FILTER (train), 0) AS va, coalesce(sum(l_extendedprice) FILTER (NOT train), 0) AS vb FROM t GROUP BY ALL),
r AS (SELECT l_linenumber, a, b, row_number() OVER (PARTITION BY l_linenumber ORDER BY va DESC, p_brand) AS ra, row_number() OVER (PARTITION BY l_linenumber ORDER BY vb DESC, p_brand) AS rb, rank() OVER (PARTITION BY l_linenumber ORDER BY a) + (count(*) OVER (PARTITION BY l_linenumber, a) - 1) / 2 AS x,
             rank() OVER (PARTITION BY l_linenumber ORDER BY b) + (count(*) OVER (PARTITION BY l_linenumber, b) - 1) / 2 AS y FROM c)
SELECT l_linenumber, count(*) AS n_labels, CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test, round(corr(x, y), 6) AS rho,
       count(*) FILTER (ra <= 5 AND rb <= 5) / least(5, count(*)) AS overlap FROM r GROUP BY l_linenumber HAVING sum(a) > 0 AND sum(b) > 0
""")
def weakness_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.rate_persistence(_split(spark, sf_dir), ["l_linenumber"], "p_brand", "l_extendedprice", F.col("train"))
    return out.select("l_linenumber", "n_labels", "n_train", "n_test", F.round("rho", 6).alias("rho"), "overlap")


@query(f"""
WITH {SPLIT_SQL}, c AS (SELECT p_brand, avg(l_extendedprice) FILTER (train) AS a, avg(l_extendedprice) FILTER (NOT train) AS b,
      count(DISTINCT CASE WHEN train THEN o_orderkey END) AS ua, count(DISTINCT CASE WHEN NOT train THEN o_orderkey END) AS ub FROM t GROUP BY p_brand),
r AS (SELECT rank() OVER (ORDER BY a) AS x, rank() OVER (ORDER BY b) AS y FROM c WHERE ua >= 4 AND ub >= 2)
SELECT count(*) AS n_shared, CASE WHEN count(*) >= 3 THEN round(corr(x, y), 6) END AS rho FROM r
""")
def opening_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.value_persistence(_split(spark, sf_dir), "p_brand", "o_orderkey", "l_extendedprice", F.col("train"))
    return out.withColumn("rho", F.round("rho", 6))


@query("""
WITH d AS (SELECT o_custkey, o_orderpriority, least(1000, CAST(floor(max(o_totalprice) / 400) AS INT)) AS cp, CAST(floor(max(o_totalprice) / 400) AS INT) AS raw FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY raw DESC, o_orderpriority) AS rank FROM d),
m AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey),
x AS (SELECT r.rank, greatest(0, b.cp - r.cp) AS cost FROM m JOIN r USING (o_custkey, o_orderpriority) JOIN r b ON b.o_custkey = m.o_custkey AND b.rank = 1)
SELECT count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS agree_1, round(avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END), 6) AS agree_2, round(avg(cost), 6) AS mean_cost,
       list_sort(list(cost))[count(*) // 2 + 1] AS median_cost, max(cost) AS max_cost, count(*) FILTER (cost >= 100) AS over_100 FROM x
""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pos_key"), F.col("o_orderpriority").alias("uci"), "o_orderkey", "o_totalprice")
    deep = orders.groupBy("pos_key", "uci").agg(F.floor(F.max("o_totalprice") / 400).cast("int").alias("score_cp"))
    deep = relational.topk_per_group(deep, ["pos_key"], [F.desc("score_cp"), F.col("uci")], 1 << 30).withColumn("mate", F.lit(None).cast("int"))
    chosen = orders.groupBy("pos_key").agg(F.min_by("uci", "o_orderkey").alias("best_uci"))
    out = evaluation.recommendations(chosen, deep)
    return out.withColumns({c: F.round(c, 6) for c in ("agree_1", "agree_2", "mean_cost")})


@query("""
SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median,
       list_sort(list(value))[CASE WHEN count(*) = 1 THEN 1 ELSE CAST(floor(0.95 * count(*)) AS BIGINT) END] AS p95 FROM events GROUP BY event_type
""")
def median_p95_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value is not null")
    n = F.col("n")
    median = relational.ranked_value(events, ["event_type"], "value", F.floor(n / 2), "median")
    p95 = relational.ranked_value(events, ["event_type"], "value", F.when(n == 1, 0).otherwise(F.floor(0.95 * n) - 1), "p95").drop("n")
    return median.join(p95, "event_type").select("event_type", "n", "median", "p95")


@query(f"""
WITH facts AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS v FROM {LINES} GROUP BY ALL),
claims AS (SELECT l_returnflag, l_linestatus, v + CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0.5 END AS claimed FROM facts
           UNION ALL SELECT 'Z', 'Z', 1.0)
SELECT count(*) AS claims, count(*) FILTER (v IS NOT NULL) AS resolved, count(*) FILTER (abs(claimed - v) <= 1) AS supported
FROM claims LEFT JOIN facts USING (l_returnflag, l_linestatus)
""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = lines_of_orders(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("v"))
    said = facts.withColumn("v", F.col("v") + F.when(F.col("l_linestatus") == "O", 5.0).otherwise(0.5))
    said = said.union(spark.createDataFrame([("Z", "Z", 1.0)], "l_returnflag string, l_linestatus string, v double"))
    out = evaluation.ground(said, facts, ["l_returnflag", "l_linestatus"], "v")
    return out.agg(F.count("*").alias("claims"), F.count_if("resolves").alias("resolved"), F.count_if("supported").alias("supported"))


@query("""
SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS hits, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderstatus IN ('F', 'O') GROUP BY o_custkey
""")
def scoped_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = relational.scoped(table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")), scope, "o_custkey")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("hits"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH ab AS (SELECT o_custkey, 0 AS turn, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')
SELECT o_custkey, o_orderkey, o_totalprice FROM ab QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY turn DESC, o_orderkey DESC, o_totalprice DESC) = 1
""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = lambda s: orders.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.upsert(rows("F"), rows("P"), ["o_custkey"])


@query("""
WITH ab AS (SELECT 0 AS turn, o_custkey, o_orderkey, length(o_orderpriority) AS seen, o_totalprice FROM orders WHERE o_orderstatus = 'F'
            UNION ALL SELECT 1, o_custkey, o_orderkey, length(o_orderpriority), o_totalprice FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, o_orderkey, CAST(sum(seen) OVER (PARTITION BY o_custkey) AS BIGINT) AS seen, o_totalprice FROM ab
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY turn, o_orderkey, o_totalprice) = 1
""")
def accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    rows = lambda keep: orders.where(keep).select("o_custkey", "o_orderkey", F.length("o_orderpriority").cast("long").alias("seen"), "o_totalprice")
    return relational.accumulate(rows(done), rows(~done), ["o_custkey"], "seen", ["o_orderkey"])


@query("SELECT count(*) AS requests, count(doc) AS hits, round(count(doc) / count(*), 6) AS rate FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS doc FROM labels) ON doc = doc_id")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.hit_rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("requests", "hits", F.round("rate", 6).alias("rate"))

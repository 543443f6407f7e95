"""Ranking metrics, temporal splits, rank correlation, grounding of claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chess
from .relational import ranked_value


def by_qrels(hits: DataFrame, qrels: DataFrame, query_id: str = "qid", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(hits with ``relevant``, (query_id, n_relevant)) where the relevant pairs are given."""
    pairs = qrels.select(query_id, doc_id).distinct().withColumn("relevant", F.lit(True))
    return hits.join(pairs, [query_id, doc_id], "left"), qrels.groupBy(query_id).agg(F.count("*").alias("n_relevant"))


def by_class(hits: DataFrame, queries: DataFrame, docs: DataFrame, of_query: str, of_doc: str, query_id: str = "qid", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """As ``by_qrels``, where documents of a query's own class are relevant: pairs of a class are counted, never made."""
    asked = queries.select(query_id, F.col(of_query).alias("__class"))
    sizes = docs.groupBy(F.col(of_doc).alias("__class")).agg(F.count("*").alias("n_relevant"))
    found = hits.join(asked, query_id).join(docs.select(doc_id, F.col(of_doc).alias("__own")), doc_id, "left")
    return found.withColumn("relevant", F.col("__own") == F.col("__class")).drop("__own", "__class"), asked.join(sizes, "__class").select(query_id, "n_relevant")


def metrics_at(queries: DataFrame, marked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...], query_id: str = "qid") -> DataFrame:
    """(query_id, n_relevant, shown; recall_k, precision_k, rr_k, hit_k, ndcg_k of each cut) of every query, in one pass over the hits.

    ``marked`` has query_id, rank and relevant (null: no), ``relevant`` each query's n_relevant. ``shown`` counts its hits.
    """
    good = lambda k: F.col("relevant") & (F.col("rank") <= k)
    gain = 1 / F.log2(F.col("rank") + 1.0)
    of = lambda k: [F.count_if(good(k)).alias(f"found_{k}"), F.min(F.when(good(k), F.col("rank"))).alias(f"first_{k}"), F.sum(F.when(good(k), gain)).alias(f"dcg_{k}")]
    sums = marked.groupBy(query_id).agg(F.count("*").alias("shown"), *(c for k in cuts for c in of(k)))
    out = queries.select(query_id).join(relevant, query_id, "left").join(sums, query_id, "left").fillna(0, ["n_relevant", "shown", *(f"found_{k}" for k in cuts)])
    there = F.col("n_relevant") > 0
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    told = lambda k: {"recall": F.when(there, F.col(f"found_{k}") / F.col("n_relevant")), "precision": F.col(f"found_{k}") / k, "rr": F.coalesce(1 / F.col(f"first_{k}"), F.lit(0.0)), "hit": (F.col(f"found_{k}") > 0).cast("int"), "ndcg": F.when(there, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal(k))}
    return out.select(query_id, "n_relevant", "shown", *(c.alias(f"{n}_{k}") for k in cuts for n, c in told(k).items()))


def ir_metrics(queries: DataFrame, hits: DataFrame, qrels: DataFrame, k: int = 10, query_id: str = "qid", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, n_relevant, recall, precision, rr, hit, ndcg) of every query; one without hits scores 0, recall is null without relevant ones."""
    return _at(metrics_at(queries, *by_qrels(hits, qrels, query_id, doc_id), (k,), query_id), k, query_id)


def class_metrics(queries: DataFrame, hits: DataFrame, docs: DataFrame, of_query: str, of_doc: str, k: int = 10, query_id: str = "qid", doc_id: str = "doc_id") -> DataFrame:
    """As ``ir_metrics``, where documents of a query's own class are relevant."""
    return _at(metrics_at(queries, *by_class(hits, queries, docs, of_query, of_doc, query_id, doc_id), (k,), query_id), k, query_id)


def _at(metrics: DataFrame, k: int, query_id: str) -> DataFrame:
    return metrics.select(query_id, "n_relevant", *(F.col(f"{n}_{k}").alias(n) for n in ("recall", "precision", "rr", "hit", "ndcg")))


def temporal_split(df: DataFrame, keys: list[str], order: list[str], test_share: float = 0.25) -> DataFrame:
    """Adds ``split``: the last floor(share * n) rows of each group, one at least, are "test".

    The cut is found on counts by the first column of ``order``; only rows that share its value there are ranked.
    """
    first, rest = order[0], order[1:] or order
    w = Window.partitionBy(*keys)
    counts = df.groupBy(*keys, first).agg(F.count("*").alias("__c"))
    counts = counts.withColumns({"__upto": F.sum("__c").over(w.orderBy(first)), "__n": F.sum("__c").over(w)})
    train = F.col("__n") - F.greatest(F.lit(1), F.floor(F.col("__n") * test_share))
    cut = F.min(F.struct("__upto", F.col(first).alias("at"), (train - (F.col("__upto") - F.col("__c"))).alias("left")))
    cuts = counts.where(F.col("__upto") > train).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(cut.alias("__cut"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = df.join(cuts, reduce(lambda a, b: a & b, same, F.lit(True)))
    at = F.col("__cut.at")
    there, later = F.col(first).eqNullSafe(at), F.coalesce(F.col(first) > at, F.col(first).isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    tied = rows.where(there).withColumn("split", F.when(place > F.col("__cut.left"), "test").otherwise("train"))
    out = rows.where(~there).withColumn("split", F.when(later, "test").otherwise("train")).union(tied)
    return out.select(*df.columns, "split")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank by value with ties sharing their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, rho): correlation of average ranks; null for constant columns and fewer than two rows."""
    r = df.withColumns({"__a": average_rank(a, keys), "__b": average_rank(b, keys)})
    s = r.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in (("__a", "__b"), ("__a", "__a"), ("__b", "__b"))), F.sum("__a").alias("sa"), F.sum("__b").alias("sb"))
    cov = lambda x, p, q: F.col(x) - F.col(p) * F.col(q) / F.col("n")
    down = F.sqrt(cov("__a__a", "sa", "sa") * cov("__b__b", "sb", "sb"))
    return s.select(*keys, "n", F.when((F.col("n") > 1) & (down > 1e-12), cov("__a__b", "sa", "sb") / down).alias("rho"))


def prediction(df: DataFrame, keys: list[str], label: str, train: Column) -> DataFrame:
    """(keys, n_test, top1, top3, base, lift, coverage): how often a group's commonest labels before the cut name those after it.

    ``base`` takes the commonest label over all groups; ``coverage`` is the share of later labels that some group had before.
    Null and empty labels don't count; ties go by label.
    """
    counts = df.where(F.length(label) > 0).groupBy(*keys, label).agg(F.count_if(train).alias("tr"), F.count_if(~train).alias("te"))
    w = Window.partitionBy(*keys).orderBy(F.desc("tr"), label)
    known = counts.groupBy(label).agg(F.sum("tr").alias("all"))
    usual = known.agg(F.min(F.struct((-F.col("all")).alias("less"), label)).getField(label).alias("usual"))  # one row
    ranked = counts.withColumn("k", F.when(F.col("tr") > 0, F.row_number().over(w))).join(known, label).join(F.broadcast(usual))
    share = lambda c: F.sum(F.when(c, F.col("te")).otherwise(0)) / F.sum("te")
    shares = {"top1": F.col("k") == 1, "top3": F.col("k") <= 3, "base": F.col(label) == F.col("usual"), "coverage": F.col("all") > 0}
    out = ranked.groupBy(*keys).agg(F.sum("te").alias("n_test"), *(share(c).alias(n) for n, c in shares.items())).where("n_test > 0")
    return out.withColumn("lift", F.col("top1") - F.col("base"))


def rate_persistence(df: DataFrame, keys: list[str], label: str, value: str, train: Column, k: int = 5) -> DataFrame:
    """(keys, n_labels, n_train, n_test, rho, overlap): whether labels are as frequent after the cut as before.

    ``rho`` is the rank correlation of their rates; ``overlap`` the share of the ``k`` labels of greatest total value
    before the cut that are among the ``k`` after it. Groups with no row on one side are left out; ties go by label.
    """
    side = lambda c: F.when(c, F.coalesce(F.col(value), F.lit(0))).otherwise(0)
    sums = df.groupBy(*keys, label).agg(F.count_if(train).alias("a"), F.count_if(~train).alias("b"), F.sum(side(train)).alias("va"), F.sum(side(~train)).alias("vb"))
    w = Window.partitionBy(*keys)
    rows = sums.withColumns({"ra": F.row_number().over(w.orderBy(F.desc("va"), label)), "rb": F.row_number().over(w.orderBy(F.desc("vb"), label))})
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n_labels"), F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), (F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)) / F.least(F.lit(k), F.count("*"))).alias("overlap"))
    # rates are counts over one number a side, so their ranks are those of the counts
    return facts.where("n_train > 0 and n_test > 0").join(spearman(sums, keys, "a", "b").select(*keys, "rho"), keys) if keys else facts.join(F.broadcast(spearman(sums, keys, "a", "b").select("rho")))


def value_persistence(df: DataFrame, label: str, unit: str, value: str, train: Column, least_train: int = 4, least_test: int = 2, least_shared: int = 3) -> DataFrame:
    """One row (n_shared, rho): rank correlation of labels' mean values before and after the cut.

    Labels count that have values in ``least_train`` units before and ``least_test`` after; ``rho`` is null for fewer
    than ``least_shared`` of them.
    """
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    units = lambda c: F.countDistinct(F.when(c & F.col(value).isNotNull(), F.col(unit)))
    rows = df.where(F.length(label) > 0).groupBy(label).agg(mean(train).alias("a"), mean(~train).alias("b"), units(train).alias("ua"), units(~train).alias("ub"))
    out = spearman(rows.where((F.col("ua") >= least_train) & (F.col("ub") >= least_test)), [], "a", "b")
    return out.select(F.col("n").alias("n_shared"), F.when(F.col("n") >= least_shared, F.col("rho")).alias("rho"))


def recommendations(chosen: DataFrame, deep: DataFrame) -> DataFrame:
    """One row that holds recommended moves against a deeper search: n, agree_1, agree_2, mean, median and max cost, over_100.

    ``chosen``: (pos_key, best_uci). ``deep``: a row for each move searched at the deeper depth, (pos_key, uci, rank, score_cp,
    mate), rank 1 the best, scores from the mover's side; the recommended move's own row gives its price there. Positions
    without the best or without the recommended move are left out.
    """
    priced = deep.withColumn("cp", chess.clamped(F.col("score_cp"), F.col("mate")))
    best = priced.where("rank = 1").select("pos_key", F.col("cp").alias("most"))
    mine = priced.select("pos_key", F.col("uci").alias("best_uci"), "cp", "rank")
    rows = chosen.join(best, "pos_key").join(mine, ["pos_key", "best_uci"]).withColumn("cost", F.greatest(F.lit(0), F.col("most") - F.col("cp")))
    share = lambda c: F.avg(c.cast("double"))
    sums = rows.agg(share(F.col("rank") == 1).alias("agree_1"), share(F.col("rank") <= 2).alias("agree_2"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("max_cost"), F.count_if(F.col("cost") >= 100).alias("over_100"))
    median = ranked_value(rows.withColumn("__all", F.lit(0)), ["__all"], "cost", F.floor(F.col("n") / 2), "median_cost")
    return sums.join(F.broadcast(median.drop("__all")), how="left").select(F.coalesce("n", F.lit(0)).alias("n"), "agree_1", "agree_2", "mean_cost", "median_cost", "max_cost", "over_100")  # one row each


def ground(claims: DataFrame, facts: DataFrame, keys: list[str], value: str, tolerance: float = 1.0) -> DataFrame:
    """Claims with ``resolves`` (their keys exist among the facts), ``supported`` (and the value is right within the tolerance)."""
    known = facts.select(*keys, F.col(value).alias("__fact"))
    joined = claims.join(known, keys, "left")
    return joined.withColumns({"resolves": F.col("__fact").isNotNull(), "supported": F.coalesce(F.abs(F.col(value) - F.col("__fact")) <= tolerance, F.lit(False))}).drop("__fact")

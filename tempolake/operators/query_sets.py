"""Evaluation queries made from the documents themselves, with what is relevant to each, and retrievers compared on them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import by_class, by_qrels, metrics_at
from .relational import at_index, topk_per_group
from .retrieval import RRF_K, reciprocal_rank_fusion

#: What answers a batch of queries (qid, text) with its k best (qid, doc_id, rank).
Retriever = Callable[[DataFrame, int], DataFrame]

# How each theme is told without its name. Fixed values.
PARAPHRASES = {
    "fork": "positions where one enemy piece ends up attacking two of mine at once",
    "hanging_piece": "moves that leave a piece undefended and free to be taken",
    "hangs_material": "moves where I simply give away material for nothing",
    "back_rank_mate": "getting checkmated on the last row behind my own pawns",
    "back_rank_weakness": "trouble on the last row with my king boxed in",
    "absolute_pin": "a piece of mine stuck in front of my king and unable to move",
    "pin": "a piece of mine frozen because something more valuable sits behind it",
    "skewer": "my valuable piece forced to move so the one behind it is captured",
    "discovered_attack": "an enemy piece stepping aside to unleash an attack from behind",
    "accepts_unsound_sacrifice": "grabbing offered material and ending up worse for it",
    "endgame_technique": "errors I make once most pieces have come off the board",
    "king_safety": "situations where my king gets exposed to attack",
    "positional_error": "quiet moves that slowly make my position worse",
}
# Cut-offs at which rankings are compared, and the least loss of a serious mistake. Fixed values.
CUTS, SERIOUS = (1, 5, 10, 20), 200


def _numbered(sets: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows with ``i``, their place from 0."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    # a row a set, first cut to the most that can be numbered
    return sets.orderBy(*order).limit(most).withColumn("i", F.row_number().over(w) - 1)


def build_query_set(docs: DataFrame, subject: str, least: int = 5, most: int = 60, per_family: int = 10, least_docs: int = 8, least_others: int = 3) -> tuple[DataFrame, DataFrame]:
    """(queries (qid, family, text, n_relevant), qrels (qid, doc_id)) of documents as ``graph.documents`` makes them.

    Lexical: mistakes in a named opening. Thematic and paraphrase: the subject's serious mistakes of a theme with one color,
    the theme named or told in other words. Relational: an opponent's mistakes in the family they play most, where
    enough of theirs are in others; and the subject's mistakes by color and phase in the four families they have most of.
    Sets of fewer than ``least`` or more than ``most`` documents are left out; ties go by name.
    """
    sized = F.col("n").between(least, most)
    me = F.lower("player") == subject.lower()
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    opening = docs.where(F.length("opening") > 0).select("doc_id", "opening").distinct()
    sets = _numbered(opening.groupBy("opening").agg(F.count("*").alias("n")).where(sized), [F.desc("n"), F.col("opening")], per_family)
    lexical = sets.select(text("lex", F.col("i").cast("string")).alias("qid"), F.lit("lexical").alias("family"), text("blunders and mistakes in the ", F.col("opening")).alias("text"), "n", "opening")
    qrels = [lexical.select("qid", "opening").join(opening, "opening").select("qid", "doc_id")]
    queries = [lexical.drop("opening")]

    told = F.create_map(*(F.lit(x) for pair in PARAPHRASES.items() for x in pair))
    serious = docs.where("is_subject_move").where((F.col("cp_loss") >= SERIOUS) & F.col("color").isin("white", "black"))
    serious = serious.select("doc_id", "color", F.explode("doc_themes").alias("theme")).where(F.col("theme").isin(*PARAPHRASES)).distinct()
    sets = _numbered(serious.groupBy("theme", "color").agg(F.count("*").alias("n")).where(sized), [F.desc("n"), F.col("theme"), F.col("color")], per_family)
    for name, short, said in (
        ("thematic", "them", text("my serious ", F.replace("theme", F.lit("_"), F.lit(" ")), " mistakes as ", F.col("color"))),
        ("paraphrase", "para", text("as ", F.col("color"), ", ", told[F.col("theme")])),
    ):
        own = sets.select(text(short, F.col("i").cast("string")).alias("qid"), F.lit(name).alias("family"), said.alias("text"), "n", "theme", "color")
        qrels.append(own.select("qid", "theme", "color").join(serious, ["theme", "color"]).select("qid", "doc_id"))
        queries.append(own.drop("theme", "color"))

    theirs = docs.where(~me & (F.length("player") > 0)).select("doc_id", F.lower("player").alias("who"), "player", "family")
    people = theirs.groupBy("who").agg(F.count("*").alias("docs"), F.min("player").alias("name")).where(F.col("docs") >= least_docs)
    people = _numbered(people, [F.desc("docs"), F.col("who")], 2 * per_family)
    families = theirs.where(F.length("family") > 0).groupBy("who", "family").agg(F.count("*").alias("n"))
    first = topk_per_group(families.withColumn("families", F.count("*").over(Window.partitionBy("who"))), ["who"], [F.desc("n"), F.col("family")], 1)
    sets = people.join(first, "who").where(sized & (F.col("families") >= 2) & (F.col("docs") - F.col("n") >= least_others))
    asked = text("Which opening variation should I prepare against ", F.col("name"), ", and what recurring mistakes do they make in those positions?")
    own = sets.select(text("rel", F.col("i").cast("string")).alias("qid"), F.lit("relational").alias("kind"), asked.alias("text"), "n", "who", "family")
    qrels.append(own.select("qid", "who", "family").join(theirs, ["who", "family"]).select("qid", "doc_id"))
    queries.append(own.select("qid", F.col("kind").alias("family"), "text", "n"))

    mine = docs.where(me)
    top = mine.where(F.length("family") > 0).groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(4).select("family")
    mine = mine.where(F.col("color").isin("white", "black") & F.col("phase").isin("middlegame", "endgame")).join(F.broadcast(top), "family", "left_semi")  # 4 rows
    sets = mine.groupBy("color", "phase").agg(F.countDistinct("doc_id").alias("n")).where(sized)
    asked = text("In the openings I play most often as ", F.col("color"), ", what do I keep getting wrong once the ", F.col("phase"), " starts?")
    own = sets.select(F.concat_ws("_", F.lit("relself"), "color", "phase").alias("qid"), F.lit("relational").alias("family"), asked.alias("text"), "n", "color", "phase")
    qrels.append(own.select("qid", "color", "phase").join(mine, ["color", "phase"]).select("qid", "doc_id").distinct())
    queries.append(own.drop("color", "phase"))
    return reduce(DataFrame.union, queries).withColumnRenamed("n", "n_relevant"), reduce(DataFrame.union, qrels)


def query_set_stats(queries: DataFrame) -> DataFrame:
    """(family, total, avg_relevant, min_relevant, max_relevant, median_relevant), with a row for all of them."""
    sizes = F.collect_list("n_relevant")
    told = [F.count("*").alias("total"), F.round(F.avg("n_relevant"), 1).alias("avg_relevant"), F.min("n_relevant").alias("min_relevant"), F.max("n_relevant").alias("max_relevant")]
    # a query set is bounded, so its sizes may be gathered
    out = queries.rollup("family").agg(*told, at_index(sizes, F.floor(F.count("*") / 2)).alias("median_relevant"))
    return out.withColumn("family", F.coalesce("family", F.lit("all")))


def compare(queries: DataFrame, qrels: DataFrame, rankings: dict[str, DataFrame], cuts: tuple[int, ...] = CUTS, query_id: str = "qid", doc_id: str = "doc_id", by_family: bool = False) -> DataFrame:
    """(retriever, family, n, empty, mrr, recall_k and ndcg_k of each cut, precision_10, hit_10) with family "all" for all.

    Queries (query_id, family) without results count as 0; a mean leaves out queries where the value is undefined. With
    ``by_family``, ``qrels`` is (doc_id, family) of all documents, and those of a query's family are relevant to it.
    """
    deepest = max(*cuts, 10)
    names = [f"{m}_{k}" for k in cuts for m in ("recall", "ndcg")] + ["precision_10", "hit_10"]
    parts = []
    for name, hits in rankings.items():
        marked = by_class(hits, queries, qrels, "family", "family", query_id, doc_id) if by_family else by_qrels(hits, qrels, query_id, doc_id)
        rows = queries.select(query_id, "family").join(metrics_at(queries, *marked, tuple(sorted({*cuts, 10})), query_id).withColumnRenamed(f"rr_{deepest}", "mrr"), query_id)
        parts.append(rows.rollup("family").agg(F.count("*").alias("n"), F.count_if(F.col("shown") == 0).alias("empty"), *(F.avg(c).alias(c) for c in ["mrr", *names])).select(F.lit(name).alias("retriever"), F.coalesce("family", F.lit("all")).alias("family"), "n", "empty", "mrr", *names))
    return reduce(DataFrame.union, parts)


def save_results(path: str, queries: DataFrame, results: DataFrame, rankings: dict[str, DataFrame]) -> None:
    """JSON lines under ``path``: ``queries``, ``results`` (as ``compare`` gives them) and ``per_query``, each query's
    documents in the order of each retriever (null where it found none)."""
    queries.write.mode("overwrite").json(f"{path}/queries")
    results.write.mode("overwrite").json(f"{path}/results")
    # a ranking is cut to its k, so a query's list is bounded
    found = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("docs")
    lists = [queries.select("qid").join(hits.groupBy("qid").agg(found), "qid", "left").select(F.lit(name).alias("retriever"), "qid", "docs") for name, hits in rankings.items()]
    reduce(DataFrame.union, lists).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/per_query")


def hybrid(queries: DataFrame, retrievers: dict[str, Retriever], k: int = 10, fetch_k: int = 30, rrf_k: int = RRF_K, doc_id: str = "doc_id") -> DataFrame:
    """(qid, doc_id, score, rank, sources): each retriever's ``fetch_k`` best, fused by reciprocal ranks."""
    return reciprocal_rank_fusion({name: r(queries, fetch_k) for name, r in retrievers.items()}, k, doc_id, rrf_k=rrf_k)

"""The preparation report and the bounded tools: parametrised plans over games, moves, positions and themes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chess
from ..operators import graph, loss, query_sets, retrieval
from ..operators.relational import all_of, counts_of, flipped, listed, scoped, top_totals, topk_per_group, worst_means

LEVEL = 300  # a position within so many centipawns counts as level


def _level(most: int = LEVEL):
    """Forced mates have no evaluation and count as level."""
    return F.abs(F.coalesce("eval_before_cp", F.lit(0))) <= most


def _mine(games: DataFrame, moves: DataFrame, subject: str) -> DataFrame:
    g = games.where(F.col("subject") == subject).select("game_id", "subject_color", "opening", "eco", "date", "url", "subject_score")
    return moves.where("is_subject_move").join(g, "game_id")


def profile(games: DataFrame, moves: DataFrame, subject: str) -> DataFrame:
    """One row: games, score, elo, first and last date, ACPL of moves beyond the book, moves by judgement."""
    g = games.where(F.col("subject") == subject).agg(F.count("*").alias("games"), F.avg("subject_score").alias("score"), F.avg("subject_elo").alias("elo"), F.min("date").alias("first"), F.max("date").alias("last"))
    kinds = counts_of("judgment", {"blunder": "blunders", "mistake": "mistakes", "inaccuracy": "inaccuracies"})
    m = _mine(games, moves, subject).where(F.col("judgment") != "book").agg(F.avg("cp_loss").alias("acpl"), F.count("*").alias("moves"), *kinds)
    return g.join(F.broadcast(m))  # one row each


def repertoire(games: DataFrame, subject: str, top: int = 5) -> DataFrame:
    rows = games.where((F.col("subject") == subject) & F.col("opening").isNotNull()).groupBy("subject_color", "opening").agg(F.count("*").alias("games"), F.avg("subject_score").alias("score"), F.count_if(F.col("subject_score") == 1).alias("wins"), F.count_if(F.col("subject_score") == 0).alias("losses"))
    return topk_per_group(rows, ["subject_color"], [F.desc("games"), F.col("opening")], top)


def weaknesses(games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str, top: int = 5) -> DataFrame:
    """Themes by their total loss."""
    rows = themes.select("game_id", "ply", "theme").join(_mine(games, moves, subject), ["game_id", "ply"])
    return top_totals(rows, ["theme"], "cp_loss", min(top, 10)).withColumnRenamed("mean", "avg_cp")


def worst_examples(games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str, k: int = 3) -> DataFrame:
    """The worst moves from level positions of each theme: one window in place of a query a theme."""
    rows = themes.select("game_id", "ply", "theme").join(_mine(games, moves, subject).where(_level()), ["game_id", "ply"])
    return topk_per_group(rows, ["theme"], [F.desc_nulls_last("cp_loss"), F.col("game_id"), F.col("ply")], k)


def opening_trouble(games: DataFrame, moves: DataFrame, subject: str, least_games: int = 4, top: int = 5, color: str | None = None) -> DataFrame:
    """Openings by mean loss beyond the book, with one color or both; ``score`` is weighted by moves."""
    keep = all_of([F.col("judgment") != "book", F.col("opening").isNotNull(), F.col("cp_loss").isNotNull(), F.col("subject_color") == color if color else None])
    rows = _mine(games, moves, subject).where(keep)
    out = worst_means(rows, "opening", "game_id", "cp_loss", least_games, min(top, 10), F.avg("subject_score").alias("score"), F.min("eco").alias("eco"))
    return out.withColumnsRenamed({"units": "games", "mean": "acpl", "n": "moves"})


def training_positions(games: DataFrame, moves: DataFrame, subject: str, themes: DataFrame | None = None, theme: str | None = None, least_loss: int = 200, count: int = 12) -> DataFrame:
    """The worst move from each level position, worst first."""
    rows = _mine(games, moves, subject).where((F.col("cp_loss") >= least_loss) & _level())
    if theme:
        rows = rows.join(themes.where(F.col("theme") == theme).select("game_id", "ply").distinct(), ["game_id", "ply"], "left_semi")
    one = topk_per_group(rows, ["pos_key"], [F.desc("cp_loss"), F.col("game_id"), F.col("ply")], 1).drop("rank")
    return one.orderBy(F.desc("cp_loss"), "pos_key").limit(min(count, 20))


def player_games(games: DataFrame, player: str, color: str | None = None, opening: str | None = None, limit: int = 25) -> DataFrame:
    """Latest games of a player; ``color`` is the subject's, also where the player is the opponent; ``opening`` in any case."""
    rows = games.where(all_of([(F.col("subject") == player) | (F.col("opponent") == player), F.col("subject_color") == color if color else None, F.col("opening").ilike(f"%{opening}%") if opening else None]))
    return rows.orderBy(F.desc_nulls_last("date"), "game_id").limit(min(limit, 25))


def opponent_report(games: DataFrame, moves: DataFrame, themes: DataFrame, opponent: str, limit: int = 10) -> dict[str, DataFrame]:
    """Header, openings, worst mistakes with their themes, and theme counts of an opponent."""
    g = games.where(F.col("opponent") == opponent)
    other = flipped("subject_color", "white", "black")
    score = F.avg(1.0 - F.col("subject_score"))
    theirs = moves.where(~F.col("is_subject_move")).join(g.select("game_id", "opening", "url"), "game_id")
    marked = theirs.join(themes.select("game_id", "ply", "theme"), ["game_id", "ply"])
    labels = themes.groupBy("game_id", "ply").agg(listed("theme").alias("themes"))
    bad = theirs.where((F.col("cp_loss") >= 100) & _level())
    return {
        "header": g.agg(F.count("*").alias("games"), score.alias("score")),
        "openings": g.where(F.col("opening").isNotNull()).groupBy(other.alias("color"), "opening").agg(F.count("*").alias("games"), score.alias("score")).orderBy(F.desc("games"), "opening", "color").limit(limit),
        "mistakes": bad.join(labels, ["game_id", "ply"], "left").orderBy(F.desc("cp_loss"), "game_id", "ply").limit(2 * limit),
        "themes": marked.groupBy("theme").agg(F.count("*").alias("n"), F.avg("cp_loss").alias("avg_cp")).orderBy(F.desc("n"), "theme").limit(limit),
    }


def similar_positions(edges: DataFrame, moves: DataFrame, pos_key: str = "", limit: int = 10, fen: str = "", families: DataFrame | None = None) -> DataFrame:
    """Positions that resemble one, given by key or FEN, each with its worst move.

    With ``families`` (pos_key, family) only positions of another opening family: those across openings.
    """
    spark, limit = edges.sparkSession, min(limit, 10)
    one = spark.createDataFrame([(pos_key, fen)], "k string, fen string")
    asked = one.select(graph.node("position", F.when(F.col("k") != "", F.col("k")).otherwise(chess.position_key(F.col("fen")))).alias("id"))
    if families is None:
        found = graph.similar_positions(edges, asked, limit)
    else:
        found = graph.similar_across_openings(edges, asked, families.select(graph.node("position", F.col("pos_key")).alias("id"), "family"), limit)
    near = found.select(F.substring_index("dst", ":", -1).alias("pos_key"), F.col("score").alias("similarity"))
    worst = moves.where(F.col("cp_loss").isNotNull()).groupBy("pos_key").agg(F.max_by(F.struct("game_id", "ply", "san", "cp_loss"), F.struct("cp_loss", "game_id", "ply")).alias("worst"))
    return near.join(worst, "pos_key", "left").orderBy(F.desc("similarity"), "pos_key").limit(limit)


def analyze_position(cache: DataFrame, positions: DataFrame, depth: int = 16) -> DataFrame:
    """For each position (fen): the deepest evaluation of the cache of at most ``depth``, nulls where it has none.

    (fen, pos_key, side_to_move, eval_cp, mate_in, win_probability of the side to move, best_move, best_san,
    principal_variation, depth). Of one depth the widest search counts. No engine runs here: what the cache lacks is what
    ``chain.work_list`` asks for. Searches that failed don't count; ``depth`` is 22 at most.
    """
    side = F.when(F.split_part("fen", F.lit(" "), F.lit(2)) == "w", "white").otherwise("black")
    asked = positions.select("fen", chess.position_key(F.col("fen")).alias("pos_key"), side.alias("side_to_move"))
    able = cache.where((F.col("depth") <= min(depth, 22)) & ~F.coalesce("failed", F.lit(False))).join(asked.select("pos_key").distinct(), "pos_key", "left_semi")
    said = F.struct("score_cp", "mate", "best_uci", "pv", "depth")
    best = able.groupBy("pos_key").agg(F.max_by(said, F.struct("depth", "multipv")).alias("e"))
    odds = F.when(F.col("e").isNotNull(), F.round(chess.win_probability(chess.clamped(F.col("e.score_cp"), F.col("e.mate"))), 3))
    found = asked.join(best, "pos_key", "left").withColumns({"win_probability": odds, "best_san": loss.san_udf("fen", F.col("e.best_uci"))})
    return found.select("fen", "pos_key", "side_to_move", F.col("e.score_cp").alias("eval_cp"), F.col("e.mate").alias("mate_in"), "win_probability", F.col("e.best_uci").alias("best_move"), "best_san", F.col("e.pv").alias("principal_variation"), "e.depth")


def similar_games(questions: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame, subject: str | None = None, limit: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank, sources and the document's columns): BM25 and the graph, fused; questions (qid, text)."""
    text = lambda q, k: retrieval.bm25(docs, q, k)
    paths = lambda q, k: graph.search(q, nodes, edges, docs, k, subject)
    return query_sets.hybrid(questions, {"bm25": text, "graph": paths}, min(limit, 10)).join(docs.drop("text"), "doc_id")


def claims(games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str, ids: DataFrame | None = None) -> DataFrame:
    """(section, subject_key, color, statement, n, value, citations): the report's statements with what they rest on.

    Repertoire claims cite the first three games by id, with ply 0; the others cite moves. ``ids`` keeps to some games.
    """
    games, moves = scoped(games, ids, "game_id"), scoped(moves, ids, "game_id")
    cite = F.struct("game_id", "ply", "san", "cp_loss", "url")
    names = ["section", "subject_key", "color", "statement", "n", "value", "citations"]
    plain = F.lit(None).cast("string")
    known = games.where((F.col("subject") == subject) & F.col("opening").isNotNull()).withColumns({"ply": F.lit(0), "san": F.lit(""), "cp_loss": F.lit(None).cast("int")})
    some = topk_per_group(known, ["opening"], [F.col("game_id")], 3).groupBy("opening").agg(F.array_sort(F.collect_list(cite)).alias("citations"))
    told = F.format_string("as %s, %s in %d games, score %.2f (%d won, %d lost)", "subject_color", "opening", "games", "score", "wins", "losses")
    r = repertoire(games, subject).join(some, "opening").select(F.lit("repertoire"), "opening", "subject_color", told, "games", "score", "citations")
    shown = worst_examples(games, moves, themes, subject).groupBy("theme").agg(F.array_sort(F.collect_list(cite)).alias("citations"))
    told = F.format_string("%s: %d times, %.0f centipawns on average", F.replace("theme", F.lit("_"), F.lit(" ")), "n", "avg_cp")
    w = weaknesses(games, moves, themes, subject).join(shown, "theme", "left").select(F.lit("weakness"), "theme", plain, told, "n", "avg_cp", "citations")
    own = topk_per_group(_mine(games, moves, subject).where((F.col("judgment") != "book") & _level()), ["opening"], [F.desc_nulls_last("cp_loss"), F.col("game_id"), F.col("ply")], 3)
    own = own.groupBy("opening").agg(F.array_sort(F.collect_list(cite)).alias("citations"))
    told = F.format_string("%s: %d games, %.0f centipawns a move", "opening", "games", "acpl")
    o = opening_trouble(games, moves, subject).join(own, "opening", "left").select(F.lit("opening"), "opening", plain, told, "games", "acpl", "citations")
    return r.union(w).union(o).toDF(*names)


def cited(said: DataFrame, games: DataFrame, moves: DataFrame, themes: DataFrame) -> DataFrame:
    """A row for each citation of each claim: ``resolves`` (the move or the game is as cited), ``supports`` (and is what the claim says)."""
    c = said.select("section", "subject_key", "color", F.explode("citations").alias("c")).select("section", "subject_key", "color", "c.game_id", "c.ply", F.col("c.san").alias("said_san"), F.col("c.url").alias("said_url"))
    rows = c.join(games.select("game_id", F.col("url").alias("true_url"), F.col("opening").alias("true_opening")), "game_id", "left")
    rows = rows.join(moves.select("game_id", "ply", F.col("san").alias("true_san")), ["game_id", "ply"], "left")
    marks = themes.select("game_id", "ply", F.col("theme").alias("subject_key")).distinct().withColumn("marked", F.lit(True))
    rows = rows.join(marks, ["game_id", "ply", "subject_key"], "left")
    right = F.when(F.col("ply") == 0, F.col("true_url") == F.col("said_url")).otherwise(F.col("true_san") == F.col("said_san"))
    is_one = F.when(F.col("section") == "weakness", F.col("marked")).otherwise(F.col("true_opening") == F.col("subject_key"))
    rows = rows.withColumn("resolves", F.coalesce(right, F.lit(False)))
    return rows.withColumn("supports", F.col("resolves") & F.coalesce(is_one, F.lit(False))).select("section", "subject_key", "color", "game_id", "ply", "resolves", "supports")


def recomputed(said: DataFrame, games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str) -> DataFrame:
    """A row for each number of each claim, made again for just that claim's key: (section, subject_key, color, what, passed)."""
    mine = _mine(games, moves, subject)
    own = games.where(F.col("subject") == subject)
    marked = themes.select("game_id", "ply", F.col("theme").alias("subject_key")).join(mine, ["game_id", "ply"])
    beyond = mine.where((F.col("judgment") != "book") & F.col("cp_loss").isNotNull())
    plain = F.lit(None).cast("string")
    facts = [
        marked.groupBy("subject_key").agg(F.count("*").alias("true_n"), F.avg("cp_loss").alias("true_value")).select(F.lit("weakness").alias("section"), "subject_key", plain.alias("color"), "true_n", "true_value"),
        own.groupBy("opening", "subject_color").agg(F.count("*").alias("true_n")).select(F.lit("repertoire"), "opening", "subject_color", "true_n", F.lit(None).cast("double")),
        beyond.groupBy("opening").agg(F.countDistinct("game_id").alias("true_n")).select(F.lit("opening"), "opening", plain, "true_n", F.lit(None).cast("double")),
    ]
    f = reduce(DataFrame.union, facts).toDF("f_section", "f_key", "f_color", "true_n", "true_value")
    rows = said.join(f, (F.col("section") == F.col("f_section")) & (F.col("subject_key") == F.col("f_key")) & F.col("color").eqNullSafe(F.col("f_color")), "left")
    checks = [F.struct(F.lit("count").alias("what"), F.coalesce(F.col("n") == F.col("true_n"), F.lit(False)).alias("passed"))]
    near = F.coalesce(F.abs(F.col("value") - F.round("true_value")) <= 1, F.lit(False))
    both = F.array(*checks, F.struct(F.lit("mean").alias("what"), near.alias("passed")))
    return rows.select("section", "subject_key", "color", F.explode(F.when(F.col("section") == "weakness", both).otherwise(F.array(*checks))).alias("c")).select("section", "subject_key", "color", "c.*")


def grounding(said: DataFrame, games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str) -> DataFrame:
    """One row: claims, with_citations, citations, resolved, supported, numeric_checks, numeric_passed."""
    n = F.count("*")
    some = said.agg(n.alias("claims"), F.count_if(F.size("citations") > 0).alias("with_citations"))
    links = cited(said, games, moves, themes).agg(n.alias("citations"), F.count_if("resolves").alias("resolved"), F.count_if("supports").alias("supported"))
    numbers = recomputed(said, games, moves, themes, subject).agg(n.alias("numeric_checks"), F.count_if("passed").alias("numeric_passed"))
    return some.join(F.broadcast(links)).join(F.broadcast(numbers))  # one row each


def grounding_issues(said: DataFrame, games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str) -> DataFrame:
    """(section, subject_key, problem, detail): every claim without citations, bad citation and wrong number."""
    links = cited(said, games, moves, themes).where(~F.col("supports"))
    problem = F.when(~F.col("resolves"), "citation does not resolve").otherwise("citation does not support claim")
    numbers = recomputed(said, games, moves, themes, subject).where(~F.col("passed"))
    none = said.where(F.coalesce(F.size("citations"), F.lit(0)) <= 0)
    return (
        none.select("section", "subject_key", F.lit("no citations").alias("problem"), F.lit("").alias("detail"))
        .union(links.select("section", "subject_key", problem, F.concat_ws(":", "game_id", "ply")))
        .union(numbers.select("section", "subject_key", F.lit("numeric mismatch"), "what"))
    )


def generate(games: DataFrame, moves: DataFrame, themes: DataFrame, subject: str, ids: DataFrame | None = None, training: int = 12) -> dict[str, DataFrame]:
    """The whole report: profile, claims by section, and training positions."""
    games, moves = scoped(games, ids, "game_id"), scoped(moves, ids, "game_id")
    return {"profile": profile(games, moves, subject), "claims": claims(games, moves, themes, subject), "training": training_positions(games, moves, subject, count=training)}


def to_dict(report: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """A report's rows as plain values, for JSON; they are bounded by the report's own limits."""
    return {name: [r.asDict(recursive=True) for r in rows.collect()] for name, rows in report.items()}


def render_markdown(said: DataFrame, subject: str) -> str:
    """The report as Markdown; its rows are bounded by the report's own limits."""
    out, section = [f"# Preparation: {subject}"], None
    for r in said.orderBy("section", F.desc_nulls_last("value"), "subject_key").collect():
        if r.section != section:
            section = r.section
            out.append(f"\n## {section.capitalize()}")
        refs = ", ".join(f"{c.game_id}:{c.ply}" for c in r.citations or [])
        out.append(f"- {r.statement}" + (f" [{refs}]" if refs else ""))
    return "\n".join(out) + "\n"

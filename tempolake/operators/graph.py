"""The property graph of players, openings, families, ECO codes, positions and themes, as edge tables; linking and traversal.

Edges are one table (src, dst, rel, and the attributes of any relation). Parallel edges are kept: they count in scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chess
from . import similarity
from .relational import with_membership
from .retrieval import tokens

# Path weights, the bonus for independent paths, and words that link to nothing. Fixed values.
WEIGHTS = {"opening": 1.0, "player": 1.5, "theme": 1.2, "family": 0.6}
INTERSECTION, THEME_BONUS = 3.0, 0.5
STOP_WORDS = ["defense", "defence", "opening", "game", "attack", "variation", "system", "the", "of", "and"]
SELF_WORDS = ["my", "me", "i", "mine"]
EDGE_COLUMNS = {"color": "string", "games": "long", "score": "double", "count": "long", "ply": "int", "avg_cp_loss": "double", "examples": "array<struct<game_id:string,ply:int,played:string,better:string,cp_loss:int,judgment:string>>"}


def node(kind: str, name: Column) -> Column:
    """Node ids; only players are lower-cased."""
    return F.concat(F.lit(f"{kind}:"), F.lower(name) if kind == "player" else name)


def _edges(df: DataFrame, src: Column, dst: Column, rel: str) -> DataFrame:
    have = set(df.columns)
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in EDGE_COLUMNS.items()))


def build(games: DataFrame, moves: DataFrame, positions: DataFrame, themes: DataFrame, least_seen: int = 2, opponents: bool = True, resembles: bool = True, top_k: int = similarity.TOP_K, threshold: float = similarity.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph."""
    named = games.where(F.col("opening").isNotNull())
    names = named.select("eco", "opening").distinct()
    opening, family = node("opening", F.col("opening")), chess.opening_family(F.col("opening"))
    edges = [_edges(names.where(family.isNotNull()), opening, node("family", family), "in_family"), _edges(names.where(F.length("eco") > 0), opening, node("eco", F.col("eco")), "has_eco")]
    plays = lambda who, color, score: named.where(F.col(who).isNotNull()).select(F.col(who).alias("player"), color.alias("color"), "opening", score.alias("s")).groupBy("player", "color", "opening").agg(F.count("*").alias("games"), F.bround(F.coalesce(F.avg("s"), F.lit(0.0)), 3).alias("score"))
    edges.append(_edges(plays("subject", F.col("subject_color"), F.col("subject_score")), node("player", F.col("player")), opening, "plays"))
    if opponents:
        flipped = F.when(F.col("subject_color") == "white", "black").otherwise("white")
        edges.append(_edges(plays("opponent", flipped, 1.0 - F.col("subject_score")), node("player", F.col("player")), opening, "plays"))
    bad = moves.where(F.col("cp_loss") >= 100)
    kept = with_membership(positions, bad, "pos_key", "erred").where((F.col("seen_count") >= least_seen) | F.col("erred"))
    keys = kept.select("pos_key")
    at = node("position", F.col("pos_key"))
    told = moves.join(games.select("game_id", "subject", "opponent", "opening"), "game_id")
    leads = told.where(F.col("opening").isNotNull() & (F.col("ply") <= 30)).groupBy("opening", "pos_key").agg(F.count("*").alias("count"), F.min("ply").alias("ply"))
    edges.append(_edges(leads.join(keys, "pos_key", "left_semi"), opening, at, "leads_to"))
    actor = told.withColumn("player", F.when(F.col("is_subject_move"), F.col("subject")).otherwise(F.col("opponent"))).where(F.length("player") > 0)
    example = F.struct("game_id", "ply", F.col("san").alias("played"), F.col("best_move_san").alias("better"), "cp_loss", "judgment")
    # the first three by game and ply: ranked before they are gathered, so no list is longer
    erred = actor.where(F.col("cp_loss") >= 100).withColumn("turn", F.row_number().over(Window.partitionBy("player", "pos_key").orderBy("game_id", "ply")))
    blunders = erred.groupBy("player", "pos_key").agg(F.count("*").alias("count"), F.bround(F.avg("cp_loss")).alias("avg_cp_loss"), F.array_sort(F.collect_list(F.when(F.col("turn") <= 3, example))).alias("examples"))
    edges.append(_edges(blunders.join(keys, "pos_key", "left_semi"), node("player", F.col("player")), at, "blunders_at"))
    labelled = themes.select("game_id", "ply", "theme").join(actor, ["game_id", "ply"])
    shown = labelled.groupBy("player", "theme", "pos_key").agg(F.count("*").alias("count"))
    edges.append(_edges(shown.join(keys, "pos_key", "left_semi"), at, node("theme", F.col("theme")), "exhibits"))
    struggles = labelled.groupBy("player", "theme").agg(F.count("*").alias("count"), F.bround(F.avg(F.coalesce("cp_loss", F.lit(0)))).alias("avg_cp_loss"))
    edges.append(_edges(struggles, node("player", F.col("player")), node("theme", F.col("theme")), "struggles_with"))
    if resembles:
        pairs = similarity.similarity_edges(similarity.features(kept.withColumn("phase", F.coalesce("phase", F.lit("middlegame")))), top_k, threshold)
        lo, hi = node("position", F.col("lo")), node("position", F.col("hi"))
        edges += [_edges(pairs, lo, hi, "resembles"), _edges(pairs, hi, lo, "resembles")]
    nodes = [kept.select(at.alias("id"), F.lit("position").alias("kind"), F.lit(None).cast("string").alias("name"))]
    people = [named.select(F.col("subject").alias("n")), *([named.select(F.col("opponent").alias("n"))] if opponents else []), blunders.join(keys, "pos_key", "left_semi").select(F.col("player").alias("n")), struggles.select(F.col("player").alias("n"))]
    everyone = reduce(DataFrame.union, people).where("n is not null").groupBy(node("player", F.col("n")).alias("id")).agg(F.lit("player").alias("kind"), F.min("n").alias("name"))
    plain = lambda df, kind, name: df.select(node(kind, name).alias("id"), F.lit(kind).alias("kind"), name.alias("name")).where("name is not null and name <> ''").distinct()
    nodes += [everyone, plain(names, "opening", F.col("opening")), plain(names, "family", family), plain(names, "eco", F.col("eco")), plain(struggles, "theme", F.col("theme"))]
    return reduce(DataFrame.union, nodes), reduce(DataFrame.unionByName, edges)


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables under ``path``; edges lie by relation, which is what traversals filter on."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as ``save`` wrote them."""
    edges = spark.read.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), edges.select("src", "dst", "rel", *EDGE_COLUMNS)


def neighbours(edges: DataFrame, nodes: DataFrame, rel: str, out: bool = True) -> DataFrame:
    """Edges of ``rel`` that leave (or reach) the given nodes (id)."""
    return edges.where(F.col("rel") == rel).join(nodes.select(F.col("id").alias("src" if out else "dst")), "src" if out else "dst", "left_semi")


def openings_played(edges: DataFrame, player: str, color: str | None = None, min_games: int = 1) -> DataFrame:
    rows = edges.where((F.col("rel") == "plays") & (F.col("src") == f"player:{player.lower()}") & (F.col("games") >= min_games))
    return (rows.where(F.col("color") == color) if color else rows).orderBy(F.desc("games"), "dst", "color")


def weaknesses(edges: DataFrame, player: str, k: int = 10) -> DataFrame:
    rows = edges.where((F.col("rel") == "struggles_with") & (F.col("src") == f"player:{player.lower()}"))
    return rows.orderBy(F.desc(F.col("count") * F.col("avg_cp_loss")), "dst").limit(k)


def similar_positions(edges: DataFrame, nodes: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """The ``k`` most similar positions of each given one."""
    rows = neighbours(edges, nodes, "resembles").where(F.col("score") >= least)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k)


def similar_across_openings(edges: DataFrame, nodes: DataFrame, families: DataFrame, k: int = 10) -> DataFrame:
    """Of the 4k most similar, those of another family (families: id, family), the first k; there may be fewer."""
    near = similar_positions(edges, nodes, 4 * k).join(families.select(F.col("id").alias("src"), F.col("family").alias("f")), "src", "left").join(families.select(F.col("id").alias("dst"), F.col("family").alias("g")), "dst", "left")
    other = near.where(~F.col("f").eqNullSafe(F.col("g"))).drop("f", "g")
    return other.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("rank"))).where(F.col("rank") <= k)


def positions_for_opening(edges: DataFrame, opening: str, min_count: int = 1) -> DataFrame:
    return edges.where((F.col("rel") == "leads_to") & (F.col("src") == f"opening:{opening}") & (F.col("count") >= min_count))


def mistakes_in_opening(edges: DataFrame, player: str | None, opening: str, min_count: int = 1) -> DataFrame:
    """Where the opening leads and the player (null: any player) errs, with the themes shown there; worst first."""
    led = positions_for_opening(edges, opening, min_count).select("dst").distinct()
    who = F.lit(True) if player is None else F.col("src") == f"player:{player.lower()}"
    erred = edges.where((F.col("rel") == "blunders_at") & who).select(F.col("src").alias("player"), "dst", "count", "avg_cp_loss", "examples").join(led, "dst", "left_semi")
    shown = edges.where(F.col("rel") == "exhibits").groupBy(F.col("src").alias("dst")).agg(F.array_sort(F.collect_set(F.substring_index("dst", ":", -1))).alias("themes"))
    return erred.join(shown, "dst", "left").orderBy(F.desc(F.col("avg_cp_loss") * F.col("count")), "dst", "player")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by kind and edges by relation."""
    a = nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")
    return a.union(edges.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n")).orderBy("what", F.desc("n"), "name")


def surfaces(nodes: DataFrame) -> DataFrame:
    """(surface, kind, id, name): whole names, and for all but players their telling words."""
    named = nodes.where(F.col("kind").isin("player", "opening", "family", "theme") & (F.length("name") > 0))
    words = named.where(F.col("kind") != "player").select(F.explode(F.array_distinct(tokens(F.col("name")))).alias("surface"), "kind", "id", "name")
    words = words.where((F.length("surface") >= 4) & ~F.col("surface").isin(STOP_WORDS))
    return named.select(F.lower("name").alias("surface"), "kind", "id", "name").union(words).distinct()


def link(queries: DataFrame, index: DataFrame, subject: str | None = None) -> DataFrame:
    """(qid, kind, id, name): nodes that a query (qid, text) names, and its colors.

    A surface with a blank must stand in the query; one without must be a word of it. "my" and the like name the subject
    where no player is. Single words are an equi-join; surfaces with a blank are tried as substrings, the stated queries
    against all of them.
    """
    asked = queries.select("qid", F.lower("text").alias("q"), F.array_distinct(tokens(F.col("text"))).alias("words"))
    word = asked.select("qid", "q", F.explode("words").alias("word"))
    single = word.join(index.where(~F.col("surface").contains(" ")).withColumnRenamed("surface", "word"), "word").select("qid", "kind", "id", "name")
    spaced = index.where(F.col("surface").contains(" "))
    many = asked.join(spaced, F.col("q").contains(F.col("surface"))).select("qid", "kind", "id", "name")
    found = single.union(many).distinct()
    colors = word.where(F.col("word").isin("white", "black")).select("qid", F.lit("color").alias("kind"), F.col("word").alias("id"), F.col("word").alias("name")).distinct()
    if subject:
        mine = asked.where(F.arrays_overlap("words", F.array(*map(F.lit, SELF_WORDS)))).join(found.where("kind = 'player'").select("qid").distinct(), "qid", "left_anti")
        found = found.union(mine.select("qid", F.lit("player").alias("kind"), F.lit(f"player:{subject.lower()}").alias("id"), F.lit(subject).alias("name")))
    return found.union(colors)


def path_scores(links: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(qid, position, path, score) along the four kinds of paths from linked nodes to positions.

    With ``parts``, positions are dealt to so many, for this sum and for ``combine`` after it.
    """
    of = lambda kind: links.where(F.col("kind") == kind).select("qid", "id")
    rel = lambda r: edges.where(F.col("rel") == r)
    leads = rel("leads_to").select(F.col("src").alias("opening"), F.col("dst").alias("position"), (F.least(F.col("count"), F.lit(5)) / 5.0).alias("w"))
    direct = of("opening").select("qid", F.col("id").alias("opening")).join(leads, "opening").select("qid", "position", F.lit("opening").alias("path"), (WEIGHTS["opening"] * F.col("w")).alias("s"))
    through = rel("in_family").select(F.col("src").alias("opening"), F.col("dst").alias("id"))
    family = of("family").join(through, "id").join(leads, "opening").select("qid", "position", F.lit("family"), WEIGHTS["family"] * F.col("w"))
    erred = rel("blunders_at").select(F.col("src").alias("id"), F.col("dst").alias("position"), (0.5 * F.least(F.col("count"), F.lit(5)) / 5.0 + 0.5 * F.least(F.col("avg_cp_loss"), F.lit(600)) / 600.0).alias("w"))
    player = of("player").join(erred, "id").select("qid", "position", F.lit("player"), WEIGHTS["player"] * F.col("w"))
    shown = rel("exhibits").select(F.col("dst").alias("id"), F.col("src").alias("position"), (F.least(F.col("count"), F.lit(3)) / 3.0).alias("w"))
    theme = of("theme").join(shown, "id").select("qid", "position", F.lit("theme"), WEIGHTS["theme"] * F.col("w"))
    paths = direct.union(family).union(player).union(theme)
    paths = paths if parts is None else paths.repartition(parts, "qid", "position")
    return paths.groupBy("qid", "position", "path").agg(F.sum("s").alias("score"))


def combine(paths: DataFrame) -> DataFrame:
    """(qid, position, score, support): paths added up, with a bonus for each further independent one (a family adds none to its opening)."""
    sums = paths.groupBy("qid", "position").agg(F.sum("score").alias("s"), F.array_sort(F.collect_set("path")).alias("support"))
    n = F.size("support") - F.when(F.array_contains("support", "opening") & F.array_contains("support", "family"), 1).otherwise(0)
    return sums.select("qid", "position", (F.col("s") + F.when(n >= 2, INTERSECTION * (n - 1)).otherwise(0.0)).alias("score"), "support")


def expand(found: DataFrame, edges: DataFrame, seeds: int = 20, k: int = 3, decay: float = 0.5) -> DataFrame:
    """``found`` and the positions that resemble its best ones; of several seeds the best names the score."""
    best = found.withColumn("seed", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "position"))).where(F.col("seed") <= seeds)
    near = similar_positions(edges, best.select(F.col("position").alias("id")).distinct(), k).select(F.col("src").alias("position"), F.col("dst").alias("other"), F.col("score").alias("sim"), "rank")
    reached = best.join(near, "position").select("qid", F.col("other").alias("position"), (F.col("score") * decay * F.col("sim")).alias("score"), "seed", "rank")
    new = reached.join(found.select("qid", "position"), ["qid", "position"], "left_anti").groupBy("qid", "position").agg(F.min(F.struct("seed", "rank", "score")).alias("b"))
    return found.union(new.select("qid", "position", "b.score", F.array(F.lit("similarity"))))


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame, k: int = 10, subject: str | None = None, with_similar: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank, explanation) of graph retrieval over documents (doc_id, pos_key, player, color, themes).

    Positions come best first; their documents must agree with the linked players and colors, and gain by a linked theme.
    A query stops after the position at which 3k documents are reached, then its documents are ranked. Without a path
    there are no results.
    """
    links = link(queries, surfaces(nodes), subject).cache()
    found = combine(path_scores(links, edges))
    if with_similar:
        found = expand(found, edges)
    lists = links.groupBy("qid").agg(*(F.collect_set(F.when(F.col("kind") == kind, F.lower("name") if kind == "player" else F.col("name"))).alias(f"{kind}s") for kind in ("player", "theme", "color")))
    rows = found.join(lists, "qid").join(docs.withColumn("position", node("position", F.col("pos_key"))), "position")
    rows = rows.where(((F.size("players") == 0) | F.array_contains("players", F.lower(F.coalesce("player", F.lit(""))))) & ((F.size("colors") == 0) | F.array_contains("colors", F.coalesce("color", F.lit("")))))
    per = rows.groupBy("qid", "position", "score").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("score"), "position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = per.withColumn("before", before).where(F.col("before") < 3 * k).select("qid", "position")
    bonus = F.when(F.arrays_overlap("themes", F.col("doc_themes")), THEME_BONUS).otherwise(0.0)
    scored = rows.join(reached, ["qid", "position"], "left_semi").withColumn("score", F.bround(F.col("score") + bonus, 4))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank", F.concat(F.lit("paths: "), F.array_join("support", "+")).alias("explanation"))


def documents(moves: DataFrame, games: DataFrame, positions: DataFrame, themes: DataFrame, least_loss: int = 100, subject_only: bool = False) -> DataFrame:
    """One document for each mistake, book moves too: doc_id, text, pos_key, player, color, doc_themes and the game's fields."""
    rows = moves.where(F.col("cp_loss") >= least_loss)
    if subject_only:
        rows = rows.where("is_subject_move")
    labels = themes.groupBy("game_id", "ply").agg(F.array_sort(F.collect_set("theme")).alias("doc_themes"))
    rows = rows.join(games.select("game_id", "subject", "opponent", "opening", "eco", "date"), "game_id").join(positions.select("pos_key", "phase"), "pos_key", "left").join(labels, ["game_id", "ply"], "left")
    rows = rows.withColumns({"player": F.when(F.col("is_subject_move"), F.col("subject")).otherwise(F.col("opponent")), "doc_themes": F.coalesce("doc_themes", F.array().cast("array<string>"))})
    told = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    motif = F.when(F.size("doc_themes") > 0, F.array_join(F.transform("doc_themes", lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", ")).otherwise("no tactical motif")
    text = F.format_string("%s. %s. %s. %s %s at move %s, %s phase. Played %s, better was %s, lost %s centipawns. ECO %s. Player %s.", motif, told("opening", "unnamed opening"), F.coalesce(F.nullif(chess.opening_family(F.col("opening")), F.lit("")), F.lit("unknown")), F.col("color"), told("judgment", "mistake"), F.col("move_number"), F.col("phase"), F.col("san"), told("best_move_san", "unknown"), F.col("cp_loss"), told("eco", "unknown"), F.col("player"))
    return rows.select(F.concat_ws(":", "game_id", F.col("ply").cast("string")).alias("doc_id"), text.alias("text"), "game_id", "ply", "pos_key", "player", "color", "doc_themes", "opening", chess.opening_family(F.col("opening")).alias("family"), "eco", "phase", "cp_loss", "judgment", "date", "is_subject_move")

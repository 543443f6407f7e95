"""The whole chain over a store: game texts to annotated moves, themes, graph and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, loss, themes
from ..sources import pgn
from ..sources.store import Store, missing_evaluations
from . import report


def ingest(store: Store, texts: DataFrame, subject: str, evals: DataFrame | None = None, depth: int = 12, most_plies: int = loss.MOST_PLIES) -> dict[str, int]:
    """Puts the games of ``texts`` (text) into the store, seen by ``subject``, and returns how many rows its tables have.

    ``evals`` (pos_key, depth, multipv, score_cp, mate, best_uci, pv, failed) go into the cache first; moves are annotated
    and mistakes get their themes from the cache at ``depth``. Running it again with the same texts changes nothing.
    """
    parsed = pgn.parse_nested(texts).persist()
    games, moves = pgn.split(parsed)
    games = pgn.for_subject(games, subject)
    store.put("games", games)
    if evals is not None:
        store.put("position_eval", evals)
    moves = pgn.with_subject(moves, games)
    cache = store.read("position_eval")
    if cache is not None:
        moves = loss.annotate(moves, cache.where(F.col("depth") == depth), most_plies)
    moves = store.put("moves", moves)
    parsed.unpersist()
    positions = store.put("positions", pgn.positions(moves, store.read("games")))
    if cache is not None:
        store.put("move_themes", themes.theme_pass(moves, positions, cache, depth))
    return {name: t.count() for name in ("games", "moves", "positions", "move_themes") if (t := store.read(name)) is not None}


def work_list(store: Store, depth: int = 12, multipv: int = 2) -> DataFrame:
    """Positions that an engine has yet to evaluate."""
    positions, cache = store.read("positions"), store.read("position_eval")
    if cache is None:
        return positions.select("pos_key", "fen")
    return missing_evaluations(positions, cache, depth, multipv)


def knowledge(store: Store, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, documents) of the store's games."""
    games, moves, positions, marks = (store.read(t) for t in ("games", "moves", "positions", "move_themes"))
    return *graph.build(games, moves, positions, marks, **options), graph.documents(moves, games, positions, marks)


def prepare_report(store: Store, subject: str, ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report on one player, of all games or those of ``ids``."""
    return report.generate(store.read("games"), store.read("moves"), store.read("move_themes"), subject, ids)

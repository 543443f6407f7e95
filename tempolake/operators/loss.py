"""Evaluation loss of consecutive moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chess
from ..functions.board import Board

#: Plies of a game that are analysed. Fixed value.
MOST_PLIES = 60


@F.pandas_udf(T.StringType())
def san_udf(fen: pd.Series, uci: pd.Series) -> pd.Series:
    """The SAN of moves; null where one is no move of its position."""

    def one(f, u):
        if f is None or u is None:
            return None
        board = Board(f)
        move = board.parse_uci(u)
        return None if move is None else board.san(move)

    return pd.Series([one(f, u) for f, u in zip(fen, uci, strict=True)], dtype=object)


def lead_loss(moves: DataFrame, game: str, order: list[str], value: Column, last: Column | None = None) -> DataFrame:
    """Adds ``before``, ``achieved`` and ``loss``: what a move gives away of the mover's evaluation.

    ``value`` is the mover's clamped evaluation before the move; the next row's belongs to the other side, so what the
    move achieved is its negative. ``last`` is that value after a game's last row; null makes its loss null.
    """
    after = F.coalesce(F.lead("before").over(Window.partitionBy(game).orderBy(*order)), last if last is not None else F.lit(None).cast("double"))
    out = moves.withColumn("before", value).withColumn("achieved", -after)
    return out.withColumn("loss", F.when(F.col("achieved").isNotNull(), F.greatest(F.lit(0), F.col("before") - F.col("achieved"))))


def annotate(moves: DataFrame, evals: DataFrame, most_plies: int = MOST_PLIES) -> DataFrame:
    """Moves with eval_before_cp (raw), mate_in, eval_after_cp, cp_loss, best_move_uci, best_move_san, judgment, from evaluations by position.

    ``moves``: game_id, ply, uci, pos_key, pos_key_after, terminal ("checkmate", "draw" or null), fen_before (without it
    there is no SAN). Moves beyond ``most_plies`` are left without evaluation and judgment. ``evals``: pos_key,
    score_cp, mate, best_uci, failed. A position evaluated twice counts once (its greatest row); terminal positions need
    no evaluation. A failed or missing evaluation on either side leaves the move unanalysed.
    """
    one = evals.groupBy("pos_key").agg(F.max(F.struct(F.coalesce("failed", F.lit(False)).alias("failed"), "score_cp", "mate", "best_uci")).alias("e"))
    before = one.select("pos_key", F.col("e").alias("b"))
    after = one.select(F.col("pos_key").alias("pos_key_after"), F.col("e").alias("a"))
    joined = moves.join(before, "pos_key", "left").join(after, "pos_key_after", "left")
    achieved = F.when(F.col("terminal") == "checkmate", F.lit(chess.CLAMP)).when(F.col("terminal").isNotNull(), F.lit(0)).when(F.col("a").isNotNull() & ~F.col("a.failed"), -chess.clamped(F.col("a.score_cp"), F.col("a.mate")))
    within = F.col("ply") <= most_plies
    known = within & F.col("b").isNotNull() & ~F.col("b.failed") & achieved.isNotNull()
    loss = F.when(known, F.greatest(F.lit(0), chess.clamped(F.col("b.score_cp"), F.col("b.mate")) - achieved)).cast("int")
    out = joined.withColumns({"eval_before_cp": F.when(known, F.col("b.score_cp")), "eval_after_cp": F.when(known, achieved).cast("int"), "cp_loss": loss, "best_move_uci": F.when(within, F.col("b.best_uci")), "mate_in": F.when(known, F.col("b.mate"))})
    out = out.withColumn("best_move_san", san_udf("fen_before", "best_move_uci") if "fen_before" in moves.columns else F.lit(None).cast("string"))
    judged = chess.judgement(F.col("cp_loss"), F.col("ply"), F.col("uci"), F.col("best_move_uci"))
    return out.withColumn("judgment", F.when(within, judged)).drop("a", "b")


def average_loss(moves: DataFrame, color: str | None = None, subject_only: bool = False, least_ply: int = chess.BOOK_PLIES) -> DataFrame:
    """One row (acpl): mean loss of moves beyond the book, 0 without any."""
    keep = (F.col("ply") >= least_ply) & (F.col("judgment") != "book")
    if color:
        keep &= F.col("color") == color
    if subject_only:
        keep &= F.col("is_subject_move")
    return moves.where(keep).agg(F.coalesce(F.avg("cp_loss"), F.lit(0.0)).alias("acpl"))

"""PGN files as games and moves."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chess
from ..functions.board import START, Board, uci

GAME_SCHEMA = "game_id string, url string, date string, white string, black string, white_elo int, black_elo int, result string, eco string, opening string, time_control string, variant string, termination string, event string, ply_count int"
MOVE_SCHEMA = "game_id string, ply int, color string, san string, uci string, fen_before string, fen_after string, clock_seconds int, lichess_eval double, terminal string"
_TAG = re.compile(r'^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]', re.M)
_TOKEN = re.compile(r"\{[^}]*\}|;[^\n]*|\(|\)|[^\s{}();]+")


def tags(text: str) -> dict[str, str]:
    return {k: re.sub(r"\\(.)", r"\1", v) for k, v in _TAG.findall(text)}


def game_id(t: dict[str, str]) -> str:
    return t.get("GameId") or t.get("Site", "").rstrip("/").rpartition("/")[2] or "unknown"


def _clock(comment: str) -> int | None:
    m = re.search(r"\[%clk (\d+):(\d+):(\d+)", comment)
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]) if m else None


def _eval(comment: str) -> float | None:
    """White's pawns; a mate is 100 for the side that gives it."""
    m = re.search(r"\[%eval (#?)(-?[\d.]+)", comment)
    return None if not m else (100.0 if not m[2].startswith("-") else -100.0) if m[1] else float(m[2])


def moves(text: str) -> list[tuple]:
    """(ply, color, san, uci, fen before, fen after, clock, eval, terminal) of the main line, up to the first illegal move."""
    body = _TAG.sub("", text)
    board, out, depth = Board(tags(text).get("FEN", START)), [], 0
    for token in _TOKEN.findall(body):
        if token in "()":
            depth += 1 if token == "(" else -1
        elif token[0] == "{":
            if out and not depth:
                out[-1][6] = _clock(token) if out[-1][6] is None else out[-1][6]
                out[-1][7] = _eval(token) if out[-1][7] is None else out[-1][7]
        elif depth or token[0] in ";$" or token in ("1-0", "0-1", "1/2-1/2", "*"):
            continue
        elif san := re.sub(r"^\d+\.+", "", token):
            move = board.parse_san(san)
            if move is None:
                break
            before, color, told = board.fen(), "white" if board.white else "black", board.san(move)
            board.push(move)
            out.append([len(out) + 1, color, told, uci(move), before, board.fen(), None, None, board.terminal()])
    return [tuple(x) for x in out]


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """(text): a row for each game of the PGN files under ``path``; files are split between games, never read whole."""
    lines = spark.read.option("lineSep", "\n[Event ").text(path)
    head = F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value")))
    return lines.where(F.trim("value") != "").select(head.alias("text"))


_NESTED = f"{GAME_SCHEMA}, moves array<struct<{', '.join(c.replace(' ', ':') for c in MOVE_SCHEMA.split(', ')[1:])}>>"


def parse_nested(texts: DataFrame) -> DataFrame:
    """A row for each game text with the game's fields and its ``moves``; to be stored or persisted before it is split."""

    def run(frames):
        names = [c.split()[0] for c in GAME_SCHEMA.split(", ")] + ["moves"]
        kinds = [c.split()[0] for c in MOVE_SCHEMA.split(", ")[1:]]
        for frame in frames:
            rows = []
            for text in frame["text"]:
                t, played = tags(text), [dict(zip(kinds, m, strict=True)) for m in moves(text)]
                number = lambda k, t=t: int(t[k]) if re.fullmatch(r"\s*-?\d+\s*", t.get(k, "")) else None
                date = (t.get("UTCDate") or t.get("Date") or "").replace(".", "-") or None
                head = (game_id(t), t.get("Site"), date, t.get("White"), t.get("Black"), number("WhiteElo"), number("BlackElo"), t.get("Result", "*"))
                rows.append((*head, t.get("ECO"), t.get("Opening"), t.get("TimeControl"), t.get("Variant", "Standard"), t.get("Termination"), t.get("Event"), len(played), played))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("white_elo", "black_elo", "ply_count")})

    return texts.mapInPandas(run, _NESTED)


def split(parsed: DataFrame, standard_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(games, moves) of ``parse_nested``; games without moves, and other variants unless asked for, are left out."""
    kept = parsed.where(F.col("ply_count") > 0)
    if standard_only:
        kept = kept.where(F.col("variant") == "Standard")
    return kept.drop("moves"), kept.select("game_id", F.inline("moves"))


def parse(texts: DataFrame, standard_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """``split`` of ``parse_nested``."""
    return split(parse_nested(texts), standard_only)


def for_subject(games: DataFrame, subject: str) -> DataFrame:
    """Games seen by one player: white if that name (in any case) is White's, else taken as black."""
    white = F.lower("white") == subject.lower()
    mine = lambda a, b: F.when(white, F.col(a)).otherwise(F.col(b))
    out = games.withColumns({"subject": mine("white", "black"), "opponent": mine("black", "white"), "subject_color": F.when(white, "white").otherwise("black"), "subject_elo": mine("white_elo", "black_elo"), "opponent_elo": mine("black_elo", "white_elo"), "speed": chess.speed(F.col("time_control"))})
    return out.withColumn("subject_score", chess.score(F.col("result"), F.col("subject_color")))


def with_subject(moves: DataFrame, games: DataFrame) -> DataFrame:
    """Moves with move_number, position keys and whether the subject made them."""
    out = moves.join(games.select("game_id", "subject_color"), "game_id")
    return out.withColumns({"move_number": chess.move_number(F.col("ply")), "pos_key": chess.position_key(F.col("fen_before")), "pos_key_after": chess.position_key(F.col("fen_after")), "is_subject_move": F.col("color") == F.col("subject_color")}).drop("subject_color")


def positions(moves: DataFrame, games: DataFrame) -> DataFrame:
    """Distinct positions, as first seen (by game, ply), with how often they were: recomputed, so loading twice counts once."""
    rows = moves.join(games.select("game_id", "eco", "opening"), "game_id")
    first = F.min(F.struct("game_id", "ply", "fen_before", "eco", "opening")).alias("f")
    out = rows.groupBy("pos_key").agg(first, F.count("*").alias("seen_count"))
    fen = F.col("f.fen_before")
    side = F.when(F.split_part(fen, F.lit(" "), F.lit(2)) == "w", "white").otherwise("black")
    return out.select("pos_key", fen.alias("fen"), "f.ply", side.alias("side_to_move"), chess.material_signature(fen).alias("material_signature"), chess.phase(fen).alias("phase"), "f.eco", "f.opening", "seen_count")

"""Column expressions for game records: keys, buckets, material, bitboards, losses and judgements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of losses in centipawns, the plies of book, and the clamp of evaluations. Fixed values.
INACCURACY, MISTAKE, BLUNDER, BOOK_PLIES, CLAMP = 50, 100, 300, 8, 1000
WIN_SLOPE = 0.00368208
# Upper bounds in seconds of base + 40 increments. Fixed values.
SPEEDS = ((30, "ultrabullet"), (180, "bullet"), (480, "blitz"), (1500, "rapid"))
PIECES = "QRBNP"


def position_key(fen: Column) -> Column:
    """The first four fields of a FEN: placement, side, castling, en passant."""
    return F.substring_index(fen, " ", 4)


def move_number(ply: Column) -> Column:
    return F.floor((ply + 1) / 2).cast("int")


def opening_family(name: Column) -> Column:
    """What stands before the first colon; null for null and empty names."""
    return F.when(F.length(name) > 0, F.trim(F.substring_index(name, ":", 1)))


def speed(time_control: Column) -> Column:
    """Bucket of a "base+increment" time control; null where it can't be read."""
    parts = F.regexp_extract(time_control, r"^\s*(\d+)\+(\d+)\s*$", 1), F.regexp_extract(time_control, r"^\s*(\d+)\+(\d+)\s*$", 2)
    seconds = parts[0].try_cast("double") + 40 * parts[1].try_cast("double")
    out = F.when(seconds.isNull(), F.lit(None).cast("string"))
    for bound, name in SPEEDS:
        out = out.when(seconds < bound, name)
    return out.otherwise("classical")


def score(result: Column, color: Column) -> Column:
    """1, 0.5 or 0 for the player of ``color``; null for unfinished games."""
    white = F.when(result == "1-0", 1.0).when(result == "0-1", 0.0).when(result == "1/2-1/2", 0.5)
    return F.when(color == "black", 1.0 - white).otherwise(white)


def piece_count(fen: Column, piece: str) -> Column:
    board = F.substring_index(fen, " ", 1)
    return F.length(board) - F.length(F.replace(board, F.lit(piece), F.lit("")))


def phase(fen: Column) -> Column:
    """endgame at 6 pieces or fewer besides kings and pawns, else opening to move 12, else middlegame."""
    heavy = sum((piece_count(fen, p) for p in "QRBNqrbn"), F.lit(0))
    return F.when(heavy <= 6, "endgame").when(F.split_part(fen, F.lit(" "), F.lit(6)).try_cast("int") <= 12, "opening").otherwise("middlegame")


def material_signature(fen: Column) -> Column:
    side = lambda pieces: F.concat(*(F.repeat(F.lit(p.upper()), piece_count(fen, p)) for p in pieces))
    return F.concat(side(PIECES), F.lit("|"), side(PIECES.lower()))


def squares(fen: Column) -> Column:
    """64 characters from a1 to h8, "." where a square is empty."""
    board = F.substring_index(fen, " ", 1)
    for n in range(1, 9):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return F.array_join(F.reverse(F.split(board, "/")), "")


def bitboard(fen: Column, piece: str) -> Column:
    """A long with bit 8 * rank + file set for each ``piece``; h8 is the sign bit. Only for bit operations."""
    board = squares(fen)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.substring(board, i + 1, F.lit(1)) == piece, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def clamped(cp: Column, mate: Column | None = None) -> Column:
    """Evaluation within +-1000; a mate for the mover is 1000, any other mate -1000, nothing is 0."""
    inside = F.coalesce(F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), cp)), F.lit(0))
    return inside if mate is None else F.when(mate > 0, F.lit(CLAMP)).when(mate.isNotNull(), F.lit(-CLAMP)).otherwise(inside)


def classify_loss(loss: Column) -> Column:
    return F.when(loss.isNull(), "unknown").when(loss >= BLUNDER, "blunder").when(loss >= MISTAKE, "mistake").when(loss >= INACCURACY, "inaccuracy").otherwise("ok")


def judgement(loss: Column, ply: Column, move: Column, best: Column) -> Column:
    """unanalysed, then book, then best, then the bucket of the loss."""
    return F.when(loss.isNull(), "unanalysed").when(ply < BOOK_PLIES, "book").when(move == best, "best").otherwise(classify_loss(loss))


def win_probability(cp: Column) -> Column:
    return 1 / (1 + F.exp(-WIN_SLOPE * cp))

"""Blocked, exact similarity joins of positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chess
from .retrieval import _keep_best

TOP_K, THRESHOLD = 5, 0.60
PIECES = "PpNnBbRrQqKk"
#: Rows of a block that are compared in one part.
BLOCK = 2048


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two bitboards; two empty ones are equal."""
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / union)


def features(positions: DataFrame) -> DataFrame:
    """pos_key, phase, turn, a bitboard for each piece (named "w" or "b" and the letter), material counts, block."""
    fen = F.col("fen")
    name = lambda p: ("w" if p.isupper() else "b") + p.lower()
    out = positions.select("pos_key", "fen", "phase", F.split_part(fen, F.lit(" "), F.lit(2)).alias("turn"), *(chess.bitboard(fen, p).alias(name(p)) for p in PIECES))
    counts = [F.bit_count(name(p)) for p in "QRBNPqrbnp"]
    side = lambda c: F.least(F.floor(sum(c, F.lit(0)) / 4), F.lit(6)).cast("int")
    return out.withColumns({"material": F.array(*counts), "block": F.struct("phase", "turn", side(counts[:5]).alias("w"), side(counts[5:]).alias("b"))})


def _king(a: str, b: str) -> Column:
    """0.5 for kings in one zone of files (a-c, d-e-f, g-h), 0.2 for files at most 2 apart."""
    place = lambda c: F.when(F.col(c) != 0, F.length(F.bin(F.call_function("shiftrightunsigned", F.col(c), F.lit(0)))) - 1)
    file = lambda c: place(c) % 8
    zone = lambda c: F.when(F.col(c) == 0, -1).when(file(c) <= 2, 0).when(file(c) <= 5, 1).otherwise(2)
    return F.when(zone(a) == zone(b), 0.5).when(F.abs(file(a) - file(b)) <= 2, 0.2).otherwise(0.0)


def score(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """(pawn similarity, whole similarity) of two feature rows with those aliases; the whole is at most the pawns'."""
    c = lambda s, n: F.col(f"{s}.{n}")
    both = lambda names: (sum((F.bit_count(c(a, n).bitwiseAND(c(b, n))) for n in names), F.lit(0)), sum((F.bit_count(c(a, n).bitwiseOR(c(b, n))) for n in names), F.lit(0)))
    pawn = 0.5 * jaccard(c(a, "wp"), c(b, "wp")) + 0.5 * jaccard(c(a, "bp"), c(b, "bp"))
    same, union = both(["wn", "wb", "wr", "wq", "bn", "bb", "br", "bq"])
    minor = F.when(union == 0, 1.0).otherwise(same / union)
    gap = F.aggregate(F.zip_with(c(a, "material"), c(b, "material"), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    material = F.greatest(F.lit(0.0), 1 - gap / 10)
    king = _king(f"{a}.wk", f"{b}.wk") + _king(f"{a}.bk", f"{b}.bk")
    return pawn, pawn * (0.6 + 0.4 * (0.5 * material + 0.25 * king + 0.25 * minor))


def top_edges(pairs: DataFrame, node: str, other: str, weight: str, k: int) -> DataFrame:
    """Undirected edges (lo, hi, score) from directed candidate pairs: each node proposes its ``k`` best, either end suffices."""
    w = Window.partitionBy(node).orderBy(F.desc(weight), F.desc(other))
    kept = pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return kept.groupBy(F.least(node, other).alias("lo"), F.greatest(node, other).alias("hi")).agg(F.max(weight).alias("score"))


def blocked_pairs(rows: DataFrame, key: str, block: str, prune: Column, weight: Column, threshold: float) -> DataFrame:
    """(block, node, other, weight) of pairs in one block whose weight reaches the threshold, in both directions.

    ``prune`` is an upper bound of ``weight``, both over the aliases a and b. Each pair is compared once. A block of over
    ``BLOCK`` rows is dealt out: its rows as "a" to one part each, as "b" to all parts.
    """
    sizes = rows.groupBy(block).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__parts"))
    sized = rows.join(sizes, block)
    a = sized.withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")).alias("a")
    b = sized.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).alias("b")
    same = (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col("a.__part") == F.col("b.__part"))
    pairs = a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (prune >= threshold))
    pairs = pairs.select(F.col(f"a.{block}").alias("block"), F.col(f"a.{key}").alias("x"), F.col(f"b.{key}").alias("y"), weight.alias("weight")).where(F.col("weight") >= threshold)
    ends = F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other"))))
    return pairs.select("block", ends.alias("e"), "weight").select("block", "e.*", "weight")


def _best_of_tiles(batches, k: int, threshold: float):
    """Rows (node, other, weight): of each tile (ids and bitboards of two parts of a block) the ``k`` best of every node."""
    for b in batches:
        for row in range(b.num_rows):
            x, xs, y, ys = (b.column(c)[row].values.to_numpy() for c in range(4))
            same = b.column(4)[row].as_py()
            sides = [(x, np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)), (y, np.full((len(y), k), -np.inf), np.zeros((len(y), k), np.int64))]
            for i in range(0, len(x), 512):
                for j in range(0, len(y), 512):
                    p, q = xs[i : i + 512, None].view(np.uint64), ys[None, j : j + 512].view(np.uint64)
                    union = np.bitwise_count(p | q)
                    s = np.where(union == 0, 1.0, np.bitwise_count(p & q) / np.maximum(union, 1))
                    s[(s < threshold) | (x[i : i + 512, None] == y[None, j : j + 512])] = -np.inf
                    # ties go to the greater node
                    _keep_best(sides[0][1][i : i + 512], sides[0][2][i : i + 512], s, -y[j : j + 512])
                    if not same:
                        _keep_best(sides[1][1][j : j + 512], sides[1][2][j : j + 512], s.T, -x[i : i + 512])
            for node, best, who in sides[: 1 if same else 2]:
                there = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, there.sum(1))), pa.array(-who[there]), pa.array(best[there])], names=["node", "other", "weight"])


def bitboard_edges(rows: DataFrame, key: str, block: str, bits: str, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(lo, hi, score): ``top_edges`` of the rows (key long, bits long) of one block by the Jaccard similarity of their bits.

    A block is dealt to parts of some ``BLOCK`` rows, and each two parts meet as one tile. A tile sends on the ``k`` best of
    each of its nodes, so no pairs are kept or sorted; the work itself stays all pairs of a block.
    """
    sizes = rows.groupBy(block).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__parts"))
    dealt = rows.join(sizes, block).withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int"))
    parts = dealt.groupBy(block, "__part").agg(F.collect_list(F.struct(key, bits)).alias("__rows"))  # some BLOCK rows each
    a, b = parts.alias("a"), parts.alias("b")
    tiles = a.join(b, (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col("a.__part") <= F.col("b.__part")))
    side = lambda n: [F.col(f"{n}.__rows").getField(c).cast("array<long>").alias(f"{n}{c}") for c in (key, bits)]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.select(*side("a"), *side("b"), (F.col("a.__part") == F.col("b.__part")).alias("same")).repartition(count)
    pairs = tiles.mapInArrow(lambda batches: _best_of_tiles(batches, k, threshold), "node long, other long, weight double")
    return top_edges(pairs, "node", "other", "weight", k)


def similarity_edges(feats: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(lo, hi, score): equi-join on the block, pawn similarity as a residual prune, then the whole score."""
    pawn, whole = score()
    pairs = blocked_pairs(feats, "pos_key", "block", pawn, whole, threshold)
    return top_edges(pairs, "node", "other", "weight", k).withColumn("score", F.round("score", 4))


def blocking_stats(df: DataFrame, block: Column) -> DataFrame:
    """(n, blocks, largest, naive, blocked): comparisons with and without blocking."""
    sizes = df.groupBy(block.alias("b")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("n").alias("largest"), F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("blocked")).select("n", "blocks", "largest", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("naive"), "blocked")

"""SimHash near-duplicates found by anchor-point covering.

A fingerprint has 64 bits and two link at ``MAX_BITS`` (4) or fewer differing bits. Of the two 32-bit halves one then
differs in at most 2 bits. The anchors of a half are the words of a covering code: the [31, 26] Hamming code (covering
radius 1) with one free bit. Between two halves at most 2 apart lies a word at most 1 from either; an anchor lies within
1 of that word, so within covering radius + 1 of both, 1 being each side's share of the threshold. Every fingerprint is
replicated to all anchors within that radius: 17 a half, against 172 if one side alone had to reach across the whole
threshold. All fingerprints of an anchor are compared, and no pair within the threshold can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, prepare, released, text_key

MAX_BITS = 4
WORDS = 4
SEED = 42
#: Fingerprints of an anchor that are compared in one task; a fuller anchor is dealt out in blocks.
BLOCK = 4096


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text; 0 without words. Null counts as empty."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n, ones = len(first), np.zeros(64, np.int64)
    last = ends[words - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + 65536], last[at : at + 65536], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp long) for every row, ``th`` 16 bytes that tell texts apart; the 64 bits of ``fp`` are to be read as unsigned."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["id", "th", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(text), text).mapInArrow(released(run), "id long, th binary, fp long")


def _anchors(half: Column, which: int) -> Column:
    """All anchors of a 32-bit half within covering radius + 1: syndrome decoding, as array<long> tagged by the half."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    bit = lambda k: F.shiftleft((F.bit_count(half.bitwiseAND(F.lit(masks[k]))) % 2).cast("int"), k)
    syndrome = bit(0) + bit(1) + bit(2) + bit(3) + bit(4)
    flip = lambda p: F.when(p == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), p - 1))
    free = F.lit(1 << 31)
    # i = 0 stands for the nearest code word alone; i and i ^ syndrome are the two bits to flip otherwise
    near = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i <= i.bitwiseXOR(syndrome)), lambda i: F.when((i != 0) & (i == i.bitwiseXOR(syndrome)), F.lit(None).cast("long")).otherwise(half.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(syndrome)))))
    both = F.concat(F.array_compact(near), F.array(half.bitwiseXOR(flip(syndrome)).bitwiseXOR(free)))
    return F.transform(both, lambda x: x.bitwiseOR(F.lit(which << 32)))


def _forest(x: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning forest of the graph of distinct fingerprints at most ``most`` bits apart (breadth first)."""
    left, u, v = x, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            node, front = front[0], front[1:]
            near = np.bitwise_count(left ^ node) <= most
            if near.any():
                found = left[near]
                u.append(np.full(len(found), node))
                v.append(found)
                front, left = np.concatenate((front, found)), left[~near]
    return u, v


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (``fp``) that keep every connection of the graph of all links.

    Each anchor (or block of an anchor of over ``BLOCK`` fingerprints) yields a spanning forest, never all its pairs.
    """
    if max_bits > 4:
        raise ValueError("the anchors cover at most 4 differing bits")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    # a fixed number of tasks: a fingerprint makes 34 rows, so their size before says little. By another expression than
    # the fingerprint, or the planner takes the partitions that there are
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    rows = fps.select("fp", F.explode(F.concat(_anchors(low, 0), _anchors(high, 1))).alias("anchor"))
    full = rows.groupBy("anchor").count().where(F.col("count") > 1).select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # the planner takes the exploded rows for as few as the fingerprints, which it may find small enough to broadcast
    rows = rows.join(full.hint("merge"), "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.select("anchor", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")

    def run(batches):
        rest = None
        for b in _chunks(batches):
            cols = np.stack([b[0], b[1] * (1 << 31) + b[2], b[3]])
            if rest is not None:
                cols = np.concatenate((rest, cols), axis=1)
            cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            if not len(cuts):
                rest = cols
                continue
            rest = cols[:, cuts[-1] :]
            yield from _compare(cols[2, : cuts[-1]].view(np.uint64), np.concatenate(([0], cuts)), max_bits)
        if rest is not None and rest.shape[1]:
            yield from _compare(rest[2].view(np.uint64), np.array([0, rest.shape[1]]), max_bits)

    return rows.mapInArrow(released(run), "u long, v long").distinct()


def _chunks(batches, rows: int = 65536):
    """Batches gathered to some ``rows`` rows, as int64 arrays."""
    held, n = [], 0
    for b in batches:
        held.append([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(b.num_columns)])
        n += b.num_rows
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _compare(x: np.ndarray, bounds: np.ndarray, most: int):
    """Edges within each run of ``x`` between ``bounds``."""
    sizes = np.diff(bounds)
    pairs = bounds[:-1][sizes == 2]
    pairs = pairs[np.bitwise_count(x[pairs] ^ x[pairs + 1]) <= most] if len(pairs) else pairs
    us, vs = [x[pairs]], [x[pairs + 1]] if len(pairs) else [x[pairs]]
    for k in np.flatnonzero(sizes > 2):
        u, v = _forest(x[bounds[k] : bounds[k + 1]].copy(), most)
        us += u
        vs += v
    u, v = np.concatenate(us), np.concatenate(vs)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def _classes(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of every row, and (fp, first id, root) of every fingerprint."""
    prepare(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col).checkpoint()
    classes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(classes.select("fp"), max_bits))
    return fps, classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable through links. Null texts are empty; empty texts share fingerprint 0
    and link like any other; repeated ids and rows stay; a null id stays and never becomes a component's id (the id of
    a component with null ids only is null). Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    fps, named = _classes(docs, id_col, text_col, max_bits)
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(firsts, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of smallest id, null last; of one id by a hash of the text."""
    o, th = fresh("__o", docs.columns), fresh("__th", docs.columns)
    keyed = docs.withColumns({o: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), th: text_key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    fps, named = _classes(keyed, id_col, text_col, max_bits)
    # the text's hash goes along with the fingerprint, so that rows of one id are told apart
    least = fps.groupBy("fp").agg(F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias(o), F.col("th").alias(th))).alias("w"))
    winners = least.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("w").alias("w")).select("w.*")
    return keyed.join(winners, [o, th], "left_semi").dropDuplicates([o, th]).drop(o, th)

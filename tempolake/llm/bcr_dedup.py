"""Repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

A window is a string of ``WINDOW`` bytes. Windows are dealt out by their minimizer (the least hash of the grams inside), so
equal windows always meet; consecutive windows of one minimizer travel as one segment of under 200 bytes. Only
minimizers that occur in two places matter, be it in one segment. The distinct segments of such minimizers form collections; each is
indexed by inserting one symbol of every segment a round, from the last to the first, updating the transform and the
longest common prefixes. Runs of common prefixes of ``WINDOW`` or more are equal windows. A round reads the sequence of the
round before from its start to its end and writes its own; the sequences of larger collections are files in the shared
folder, in blocks, and a round holds one block of them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, packed, prepare, released, shared_dir, stored, text_key

WINDOW, GRAM = 100, 40
SPAN = WINDOW - GRAM + 1
#: Segments that are indexed together, if a minimizer has no more by itself.
BLOCK_SEGMENTS = 400
#: Suffixes of a collection beyond which its sequences are files, and of a block of such a file.
MEMORY_SUFFIXES, FILE_BLOCK = 400_000, 1 << 18
#: Places of a minimizer beyond which its windows are grouped one by one over all tasks: a collection is one task's work.
MOST_SEGMENTS = 20_000
#: Minimizers that a task combines before it sends them on, texts and segments that it remembers.
COMBINE, REMEMBERED = 400_000, 50_000
#: Parts that the places of one minimizer are dealt out to where they are marked as very many.
SALTS = 64
#: More than a segment's bytes.
OFFSETS = 256
LAST = (1 << 63) - 1


def window_runs(data: np.ndarray):
    """(minimizer, first window, windows, inner) of each run of windows with one minimizer, at most ``SPAN`` windows long.

    ``inner``: windows of the run itself may be equal. Such windows hold the minimizer at one offset, so in two places of
    the text; as the first place leaves the windows, the minimizer stays.
    """
    n = len(data) - GRAM + 1
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for o in range(0, GRAM, 8):
        h ^= eight[o : o + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    grams, cover = h, 1
    while cover * 2 <= SPAN:
        h = np.minimum(h[:-cover], h[cover:])
        cover *= 2
    if cover < SPAN:
        h = np.minimum(h[: -(SPAN - cover)], h[SPAN - cover :])
    starts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(h)))
    parts = -(-sizes // SPAN)
    of = np.repeat(np.arange(len(starts)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = starts[of] + k * SPAN
    inner = np.zeros(len(of), bool)
    stays = np.flatnonzero((grams[: len(h) - 1] == h[:-1]) & (h[1:] == h[:-1]))
    inner[np.searchsorted(first, stays, side="right") - 1] = True
    return h[starts][of], first, np.minimum(SPAN, starts[of] + sizes[of] - first), inner


class _Memory:
    """The transform and the common prefixes of all suffixes in order, as one block."""

    def __init__(self, kind):
        self.blocks, self.sizes = [], ()

    def new(self):
        return _Memory(None)

    def add(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.append((bwt, lcp))

    def close(self) -> None:
        pass

    def read(self):
        return iter(self.blocks)

    drop = close


class _File:
    """The same in blocks of a file, which is written once from start to end and read in the same order."""

    def __init__(self, kind, folder: str):
        self.kind, self.folder, self.sizes = np.dtype(kind), folder, []
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path.rstrip('/')}/suffixes-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path)

    def new(self):
        return _File(self.kind, self.folder)

    def add(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        for at in range(0, len(bwt), FILE_BLOCK):
            part = bwt[at : at + FILE_BLOCK]
            self.sizes.append(len(part))
            self.out.write(part.tobytes())
            self.out.write(lcp[at : at + FILE_BLOCK].tobytes())

    def close(self) -> None:
        self.out.close()

    def read(self):
        with self.fs.open_input_stream(self.path) as f:
            for n in self.sizes:
                yield np.frombuffer(f.read(n * self.kind.itemsize), self.kind), np.frombuffer(f.read(n * 2), np.int16)

    def drop(self) -> None:
        self.fs.delete_file(self.path)


def _least(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of lcp[a + 1 .. b] for each pair a < b; ``padded`` is lcp with one more value."""
    if not len(a):
        return np.zeros(0, np.int16)
    cuts = np.empty(2 * len(a), np.int64)
    np.add(a, 1, out=cuts[::2])
    np.add(b, 1, out=cuts[1::2])
    return np.minimum.reduceat(padded, cuts)[::2]


def _scan(sequence, place: np.ndarray, base: np.ndarray, total: np.ndarray):
    """For places in order: where the suffix with the place's symbol before it belongs, and its common prefixes there.

    ``base`` is where the suffixes of each first symbol begin, ``total`` counts the sequence's symbols. The common prefixes are one more than the least between
    the place and the one before (after) it with the same symbol, and 0 without such.
    """
    rank, low, high = np.empty(len(place), np.int64), np.zeros(len(place), np.int16), np.zeros(len(place), np.int16)
    seen, at = base.copy(), 0
    # of each symbol: the least prefix since its last occurrence in the blocks before, and the place there that has no next yet
    met, since, left = np.zeros(len(base), bool), np.full(len(base), 32767, np.int16), np.full(len(base), -1)
    for bwt, lcp in sequence.read():
        i, j = np.searchsorted(place, [at, at + len(bwt)])
        p = place[i:j] - at
        order = np.argsort(bwt, kind="stable")
        counts = np.bincount(bwt, minlength=len(base)) if len(sequence.sizes) > 1 else total
        starts = np.cumsum(counts) - counts
        # w: where the places are in that order; marks of the places, read in it, are the places by symbol
        marks, c, w = np.zeros(len(bwt), bool), bwt[p], np.empty(len(p), np.int64)
        marks[p] = True
        w[np.argsort(c, kind="stable")] = np.flatnonzero(marks[order])
        rank[i:j] = seen[c] + w - starts[c]
        padded = np.append(lcp, np.int16(32767))
        k = np.flatnonzero(w > starts[c])
        low[i + k] = 1 + _least(padded, order[w[k] - 1], p[k])
        k = np.flatnonzero(w < starts[c] + counts[c] - 1)
        high[i + k] = 1 + _least(padded, p[k], order[w[k] + 1])
        if len(sequence.sizes) > 1:
            so_far, here = np.minimum.accumulate(lcp), np.flatnonzero(counts)
            first, final = order[starts[here]], order[starts[here] + counts[here] - 1]
            k = np.flatnonzero((w == starts[c]) & met[c])
            low[i + k] = 1 + np.minimum(since[c[k]], so_far[p[k]])
            k = left[here] >= 0
            high[left[here][k]] = 1 + np.minimum(since[here], so_far[first])[k]
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(32767))
            since = np.minimum(since, so_far[-1])
            since[here], left[here], met[here] = after[final + 1], -1, True
            k = np.flatnonzero(w == starts[c] + counts[c] - 1)
            left[c[k]] = i + k
        seen += counts
        at += len(bwt)
    return rank, low, high


def _insert(blocks, n: int, out, new: np.ndarray, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Writes the ``n`` suffixes of ``blocks`` and those that belong at ``new``, in order."""
    spot, at, i = new - np.arange(len(new)), 0, 0  # spot: the old suffix that each comes before
    for bwt, lcp in blocks:
        end = at + len(bwt)
        j = len(new) if end == n else int(np.searchsorted(spot, end))
        s = spot[i:j] - at
        follows = np.append(s[1:] != s[:-1], True)[: len(s)] & (s < len(bwt))
        put = new[i:j] - at - i
        old = np.ones(len(bwt) + len(put), bool)
        old[put] = False
        grown = []
        for x, y in ((bwt, symbol), (lcp, low)):
            g = np.empty(len(old), x.dtype)
            g[old], g[put] = x, y[i:j]
            grown.append(g)
        grown[1][put[follows] + 1] = high[i:j][follows]
        out.add(*grown)
        at, i = end, j
    out.close()


def column_index(segments: list[bytes], folder: str | None = None):
    """(suffixes in order as segment * ``OFFSETS`` + offset, common prefix of each with the one before) of a collection.

    Round t inserts the suffix of length t of every segment that has one: its place follows from the rank of its first
    symbol in the transform so far, its common prefixes from the least one between two of that symbol. With ``folder``,
    sequences of over ``MEMORY_SUFFIXES`` are files there.
    """
    count = len(segments)
    sizes = np.array([len(s) for s in segments])
    width = int(sizes.max())
    # symbols from the end, numbered by byte, 0 beyond the beginning
    used = np.unique(np.frombuffer(b"".join(segments), np.uint8))
    kind = np.uint8 if len(used) < 256 else np.uint16
    number = np.zeros(256, kind)
    number[used] = np.arange(1, len(used) + 1)
    column = np.zeros((width + 1, count), kind)
    for k, s in enumerate(segments):
        column[: len(s), k] = number[np.frombuffer(s, np.uint8)[::-1]]
    sequence = _File(kind, folder) if folder and int(sizes.sum()) > MEMORY_SUFFIXES else _Memory(kind)
    sequence.add(column[0].copy(), np.zeros(count, np.int16))
    sequence.close()
    total, n = np.bincount(column[0], minlength=len(used) + 1), count
    live = np.flatnonzero(sizes > 0)
    place = live
    for t in range(1, width + 1):
        rank, low, high = _scan(sequence, place, _bases(total, count), total)
        by = np.argsort(rank)
        live, place = live[by], rank[by]
        symbol, grown = column[t, live], sequence.new()
        _insert(sequence.read(), n, grown, place, symbol, low[by], high[by])
        sequence.drop()
        sequence, n = grown, n + len(live)
        total = total + np.bincount(symbol, minlength=len(total))
        stay = sizes[live] > t
        live, place = live[stay], place[stay]
    bwt, lcp = (np.concatenate(x) for x in zip(*sequence.read(), strict=True))
    sequence.drop()
    # from the empty suffixes, the first ones, each step leads to the suffix with one symbol more
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n) - np.count_nonzero(bwt == 0) + count
    name = np.empty(n, np.int64)
    live = place = np.arange(count)
    for t in range(width + 1):
        name[place] = live * OFFSETS + sizes[live] - t
        stay = sizes[live] > t
        live, place = live[stay], step[place[stay]]
    return name, lcp


def _bases(total: np.ndarray, count: int) -> np.ndarray:
    """Where the suffixes of each first symbol begin, behind the ``count`` empty ones."""
    full = np.where(np.arange(len(total)) == 0, 0, total)
    return count + np.cumsum(full) - full


def repeats(segments: list[bytes], orders: list[tuple[int, int]], folder: str | None = None) -> list[tuple[int, int, int]]:
    """(segment, first window, windows) of each run of windows that have an equal earlier one in the collection.

    ``orders`` are the (document, start) places of the segments' first bytes.
    """
    name, lcp = column_index(segments, folder)
    sizes = np.array([len(s) for s in segments])
    seg, at = name // OFFSETS, name % OFFSETS
    whole = sizes[seg] - at >= WINDOW
    group = np.cumsum(lcp < WINDOW)[whole]
    seg, at = seg[whole], at[whole]
    doc, first = (np.array(x, np.int64) for x in zip(*orders, strict=True))
    d, start = doc[seg], first[seg] + at
    by = np.lexsort((start, d, group))
    g, s, x, d = group[by], start[by], seg[by], d[by]
    new = np.append(True, g[1:] != g[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d != d[head]) | (s != s[head])
    pairs = np.unique(np.stack([x[later], at[by][later]], axis=1), axis=0)
    if not len(pairs):
        return []
    cut = np.flatnonzero((np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 1)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(pairs))
    return [(int(pairs[a, 0]), int(pairs[a, 1]), int(b - a)) for a, b in zip(lo, hi, strict=True)]


def _minimizers(docs: DataFrame) -> DataFrame:
    """(h, k, tag) of documents (th, k, text): runs of windows of the texts; ``k`` is a hash of the text.

    ``tag`` is start << 16 | windows << 2 | known << 1 | sent. Known: the same task saw the minimizer in another place
    too, or windows of the run may be equal; of a minimizer that a task sees in several places one row alone is sent to meet other tasks' rows. A task looks
    into equal texts once, as far as it remembers them.
    """

    def run(batches):
        held, n, seen = [], 0, set()
        for b in batches:
            for th, k, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if th in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(th)
                h, a, count, inner = window_runs(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                if len(h):
                    held.append((h.view(np.int64), np.full(len(h), k, np.int64), a << 16 | count << 2 | inner.astype(np.int64) << 1))
                    n += len(h)
            if n >= COMBINE:
                yield combined(held)
                held, n = [], 0
        if held:
            yield combined(held)

    def combined(held):
        h, k, tag = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(h, kind="stable")
        h, k, tag = h[by], k[by], tag[by]
        first = np.append(True, h[1:] != h[:-1])
        counts = np.diff(np.append(np.flatnonzero(first), len(h)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, k, tag | np.repeat(counts > 1, counts) << 1 | first)], names=["h", "k", "tag"])

    return docs.select("th", "k", "text").mapInArrow(released(run), "h long, k long, tag long")


def _repeated(rows: DataFrame) -> DataFrame:
    """(h, k, start, n): the rows of ``_minimizers`` that are known or whose minimizer others have; a few may be twice."""
    rows = rows.repartition(F.when(F.col("tag").bitwiseAND(F.lit(1)) == 1, F.col("h")).otherwise(F.xxhash64("k", "tag"))).sortWithinPartitions("h")

    def run(batches):
        rest, hot = None, None
        for b in batches:
            t = [b.column(c).to_numpy() for c in range(3)]
            rest = t if rest is None else [np.concatenate(x) for x in zip(rest, t, strict=True)]
            if len(rest[0]) < 100_000:
                continue
            h = rest[0]
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield picked(*(x[:cut] for x in rest), hot)
                rest = [x[cut:] for x in rest]
            else:  # a minimizer with so many rows is repeated, here and further on
                hot = h[-1]
                yield picked(*rest, hot)
                rest = None
        if rest is not None:
            yield picked(*rest, hot)

    def picked(h, k, tag, hot):
        keep, sent = tag & 2 != 0, np.flatnonzero(tag & 1)
        if len(sent):
            mine = h[sent]
            starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            places = np.zeros(len(starts), bool)  # the same place of equal texts, told by several tasks, is one
            for x in (k[sent], tag[sent] >> 16):
                places |= np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts)
            keep[sent] |= np.repeat(places, np.diff(np.append(starts, len(mine)))) | (False if hot is None else mine == hot)
        h, k, tag = h[keep], k[keep], tag[keep]
        cols = [pa.array(h), pa.array(k), pa.array((tag >> 16).astype(np.int32)), pa.array((tag >> 2 & 0x3FFF).astype(np.int16))]
        return pa.RecordBatch.from_arrays(cols, names=["h", "k", "start", "n"])

    return rows.mapInArrow(released(run), "h long, k long, start int, n short")


_unpacked = zstandard.decompress


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _once(rows: DataFrame) -> DataFrame:
    """(th, o, packed): the texts of rows (th, o, text); a row goes out unless its task remembers an equal text before it."""

    def run(batches):
        pack, least = zstandard.ZstdCompressor(level=1).compress, {}
        for b in batches:
            out = []
            for th, o, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if least.get(th, o + 1) <= o:
                    continue
                if len(least) >= REMEMBERED:
                    least.clear()
                least[th] = o
                out.append((th, o, pack(t.encode("utf-8", "surrogatepass"))))
            if out:
                yield _batch(out, ["th", "o", "packed"], [pa.binary(), pa.int64(), pa.binary()])

    return rows.select("th", "o", "text").mapInArrow(released(run), "th binary, o long, packed binary")


def _pieces(spotted: DataFrame) -> DataFrame:
    """(h, segment, d, start, n, window) of documents (d, packed, spots).

    A task sends a segment once, with its first place in the task; other places of it are known to repeat and go without
    bytes. Minimizers of very many places go as the digests of their single windows, each once likewise; windows in a row
    that are known to repeat go as one run.
    """
    names, kinds = ["h", "segment", "d", "start", "n", "window"], [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        firsts: dict[tuple, tuple] = {}
        out: list[tuple] = []

        def told(key, place):
            """The place that is known to repeat, if there is one."""
            old = firsts.setdefault(key, place)
            if old == place:
                return None
            firsts[key] = min(old, place)
            return max(old, place)

        def joined(places):
            """(d, start, n) of the places of single windows, in runs."""
            runs: list[list[int]] = []
            for d, k in sorted(places):
                if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] == k:
                    runs[-1][2] += 1
                else:
                    runs.append([d, k, 1])
            return runs

        def flushed():
            for (h, segment, window), place in firsts.items():
                out.append((h, segment, *place, 1 if segment is None else len(segment) - WINDOW + 1, window))
            firsts.clear()

        for b in batches:
            for d, t, spots in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = _unpacked(t)
                for s in spots:
                    h, a, n = s["h"], s["start"], s["n"]
                    if a + n + WINDOW - 1 > len(data):  # of another text with the same hash
                        continue
                    if s["hot"]:
                        places = (told((h, None, hashlib.sha256(data[k : k + WINDOW]).digest()), (d, k)) for k in range(a, a + n))
                        out += [(h, None, *run, None) for run in joined(x for x in places if x)]
                    elif place := told((h, data[a : a + n + WINDOW - 1], None), (d, a)):
                        out.append((h, None, *place, n, None))
            if len(firsts) >= REMEMBERED:
                flushed()
            if out:
                yield _batch(out, names, kinds)
                out = []
        flushed()
        if out:
            yield _batch(out, names, kinds)

    return spotted.select("d", "packed", "spots").mapInArrow(released(run), "h long, segment binary, d long, start int, n int, window binary")


_RUNS = "d long, start int, n int, window binary"


def _run_batch(rows):
    return _batch(rows, ["d", "start", "n", "window"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _matters(group: dict) -> bool:
    """Whether windows of the distinct segments of a minimizer can be equal; for a segment alone, whether its own can.

    All windows of a segment share its middle bytes, which occur once more if two of the windows are equal.
    """
    if len(group) != 1:
        return bool(group)
    (segment,) = group
    n = len(segment) - WINDOW + 1
    return segment.find(segment[n - 1 : WINDOW], n) >= 0


def _indexed(pieces: DataFrame, folder: str) -> DataFrame:
    """Runs (d, start, n) of windows that have an equal earlier one, and single windows that are yet to be compared."""
    rows = pieces.repartition(F.when(F.col("segment").isNull(), F.xxhash64("d", "start")).otherwise(F.col("h"))).sortWithinPartitions("h", "d", "start")

    def run(batches):
        segments, orders, group, last, out = [], [], {}, None, []
        for b in batches:
            whole = b.column(1).is_valid()
            if whole.true_count < len(b):
                yield b.filter(pc.invert(whole)).select(["d", "start", "n", "window"])
                b = b.filter(whole)
            for h, segment, d, a, n in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if h != last:
                    if _matters(group):
                        segments += group
                        orders += group.values()
                    if len(segments) >= BLOCK_SEGMENTS:
                        out += found(segments, orders)
                        segments, orders = [], []
                    group, last = {}, h
                if group.setdefault(segment, (d, a)) != (d, a):
                    out.append((d, a, n, None))
            if out:
                yield _run_batch(out)
                out = []
        if _matters(group):
            segments += group
            orders += group.values()
        if segments and (out := found(segments, orders)):
            yield _run_batch(out)

    def found(segments, orders):
        return [(orders[s][0], orders[s][1] + a, n, None) for s, a, n in repeats(segments, orders, folder)]

    return rows.select("h", "segment", "d", "start", "n", "window").mapInArrow(released(run), _RUNS)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(th, o, gone array<struct<start, n>>) for each distinct text ``th`` of rows (o, th, k, text), with its first o.

    ``gone`` are runs of windows that start earlier too, null without any. Later rows of equal text aren't looked into.
    """
    folder = shared_dir(rows.sparkSession)
    # texts numbered in the order of their first rows
    numbers = stored(rows.groupBy("th", "k").agg(F.min("o").alias("o")).orderBy("o", "th").withColumn("d", F.monotonically_increasing_id()), "numbers")
    spots = stored(_repeated(_minimizers(rows)), "minimizers")
    hot = spots.groupBy("h").count().where(F.col("count") > MOST_SEGMENTS).select("h", F.lit(True).alias("hot"))
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # its places are dealt out
    salted = spots.withColumn("salt", F.pmod(F.xxhash64("k", "start"), F.lit(SALTS)).cast("int"))
    spot = F.struct("h", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    by_text = salted.join(hot, ["h", "salt"], "left").groupBy("k").agg(F.collect_set(spot).alias("spots"))
    spotted = _once(rows).join(by_text.join(numbers, "k").select("th", "o", "d", "spots"), ["th", "o"])
    runs = stored(_indexed(_pieces(spotted), folder), "runs")
    drop(spots)
    # windows of minimizers with very many places meet one by one; a task has sent each once
    at = F.struct("d", "start")
    single = runs.where("window is not null")
    least = single.groupBy("window").agg(F.min(at).alias("first"))
    later = single.join(least, "window").where(at != F.col("first")).select("d", "start", "n")
    gone = runs.where("window is null").select("d", "start", "n").union(later).groupBy("d").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    found = stored(numbers.join(gone, "d", "left").select("th", "o", "gone"), "repeats")
    drop(numbers, runs)
    return found


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row: what a ``WINDOW``-byte string that starts earlier covers goes.

    Earlier: in a document of smaller id, or before in the same one, all judged on the input. Null texts are empty. Null
    ids come last; of one id, documents go by the SHA-256 of the text, of which 16 bytes tell texts apart, and rows of the
    same id and text are one document. Other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"), text_key(text).alias("th"), text.alias("text"))
    facts = repeated_windows(rows.select("o", "th", F.xxhash64("th").alias("k"), "text")).withColumn("first", F.lit(True))

    def cut(batches):
        for b in batches:
            out = []
            for i, first, t, gone in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = _unpacked(t)
                if not first:  # its text is that of an earlier row
                    gone = [{"start": 0, "n": len(data) - WINDOW + 1}] if len(data) >= WINDOW else []
                spans: list[list[int]] = []
                for a, e in sorted((g["start"], g["start"] + g["n"] + WINDOW - 1) for g in gone or []):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([a, e])
                cuts = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:e] for a, e in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((i, len(data), len(data) - len(kept), len(spans), kept))
            if out:
                yield _batch(out, ["id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary()])

    out = packed(rows).join(facts, ["th", "o"], "left").select("id", "first", "packed", "gone")
    return out.mapInArrow(released(cut), "id long, n_bytes long, n_removed long, n_spans long, kept binary")

"""Line deduplication by a deletion-neighbourhood join: lines within one edit of an earlier line go.

The unit of an edit is a word (insertion, deletion or substitution of one) for lines of ``LEAST_WORDS`` words or more, so
one changed, added or lost word, with any change of letters inside it, is within the bound. With ``characters`` the unit is
a character besides, for lines of any number of words. That takes all places of shorter lines (scripts without blanks among
them); in longer ones only edits of a blank aren't edits of a word, so places that are or can become a blank do. A line's deletion neighbourhood is itself and the line without each of
its words. Two lines are within one edit if they are equal, or equal without the same one word (substitution), or one is
the other without a word. Equal variants are grouped under hashed keys. A task compares the variants it has with the
earliest of their group first and sends on only those earliest and what it couldn't settle, so hot groups are reduced
before they move, and no group yields all its pairs. Of lines of ``LEAST_WORDS`` words or more, a letter can turn into a
blank at almost any place; only lines that share a half, but for blanks, with a line of one word more and one letter less
(or the reverse) give those variants.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, packed, prepare, released, stored

#: Lines of fewer words have characters as their unit, or go only if they are equal to an earlier line.
LEAST_WORDS = 8
LAST = (1 << 63) - 1
_digest, _digest128 = xxhash.xxh64_digest, xxhash.xxh3_128_digest
#: Keys of half lines or variants that a task combines before it sends them on, and rows of them that it looks at together.
COMBINE, MEETING = 400_000, 100_000


def split_lines(text: str) -> list[list[str]]:
    """The words that each line is compared by, in lower case; white space doesn't count."""
    return [line.split() for line in text.lower().split("\n")]


def edits(a: list[str], b: list[str]) -> int:
    """Words (of strings: characters) to insert, delete or substitute to make ``b`` of ``a``; 2 stands for more than one."""
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    s = 0
    while s < len(a) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return min(2, max(len(a), len(b)) - p - s)


def near(a: str, b: str, characters: bool) -> bool:
    """Whether two lines are within one edit."""
    v, w = a.split(" "), b.split(" ")
    return (min(len(v), len(w)) >= LEAST_WORDS and edits(v, w) <= 1) or (characters and edits(a, b) <= 1)


def _line_key(w: list[str]) -> bytes:
    """16 bytes that stand for a line's words; the first eight alone are k1."""
    return _digest128(_bytes(w))


def _longs(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.int64)


def _bytes(w: list[str]) -> bytes:
    return " ".join(w).encode("utf-8", "surrogatepass")


def _half_keys(w: list[str]) -> tuple[bytes, set[bytes]]:
    """The line's key, and hashes of its first and last words: two lines one edit apart share one of them."""
    n = len(w)
    h = n // 2
    a, b = _bytes(w[:h]), _bytes(w[n - h :])
    keys = {_digest(a, h * 2 + 4), _digest(b, h * 2 + 3)}
    if n % 2:
        return _digest128(b"%b %b %b" % (a, _bytes(w[h : h + 1]), b)), keys
    # a half without its inner word meets the halves of lines with one word less
    return _digest128(b"%b %b" % (a, b)), keys | {_digest(a[: a.rindex(b" ")], h * 2 + 2), _digest(b[b.index(b" ") + 1 :], h * 2 + 1)}


def _char_half_keys(norm: str) -> tuple[bytes, set[bytes]]:
    """``_half_keys`` with characters for words."""
    n = len(norm)
    h = n // 2
    key = lambda x, k: _digest(x.encode("utf-8", "surrogatepass"), h * 2 + k + (1 << 40))
    keys = {key(norm[:h], 4), key(norm[n - h :], 3)}
    if n % 2 == 0:
        keys |= {key(norm[: h - 1], 2), key(norm[n - h + 1 :], 1)}
    return _digest128(norm.encode("utf-8", "surrogatepass")), keys


def _variant_keys(norm: bytes) -> tuple[bytes, list[bytes]]:
    """Hashes of a line and of the line without each of its words; a line's own is that of a longer one without the word."""
    w = norm.split(b" ")
    n, at, found = len(w), 0, []
    for x in w[:-1]:
        end = at + len(x) + 1
        found.append(_digest128(norm[:at] + norm[end:], n + 99))
        at = end
    found.append(_digest128(norm[: at - 1], n + 99))
    return _digest128(norm, n + 100), found


def _mixed(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    for m in more:
        x = (x ^ (m.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


#: Of the sums of powers that stand for characters: bases of one modulo 2 ** 64 and one modulo a prime, which gives ``check``.
BASE, PRIME, PRIME_BASE = 0x9E3779B97F4A7C15, 2147483647, 1103515245


def _powers(n: int, base: int, modulus: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        more = out * np.uint64(pow(base, len(out), modulus))
        out = np.concatenate((out, more if modulus >> 64 else more % np.uint64(modulus)))
    return out


def _char_keys(norms: list[str], split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, role, key, check) of the lines and of the lines without a character, by sums of powers.

    Lines of ``LEAST_WORDS`` words or more give their own key, and those without a blank. For a letter that may have
    become a blank they give the other places too, with ``split``, and nothing else; a line of just ``LEAST_WORDS``
    words always gives its blanks, to be found by shorter lines.
    """
    sizes = np.array([len(x) for x in norms])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(norms)), sizes)
    c = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), np.uint32)
    pos = np.arange(len(c)) - (ends - sizes)[of]
    blank = c == 32
    words = np.array([x.count(" ") + 1 for x in norms])
    if split:
        beside = np.append(True, blank[:-1]) | np.append(blank[1:], True) | (pos == 0) | (pos == sizes[of] - 1)
        one, two = np.zeros(0, np.int64), np.flatnonzero(blank | ~beside)
    else:
        short = (words < LEAST_WORDS)[of]
        one, two = np.flatnonzero(short | blank), np.flatnonzero(short | (blank & (words == LEAST_WORDS)[of]))
    at = np.union1d(one, two)
    line = of[at]
    start, end = (ends - sizes)[line], ends[line]
    letters = c.astype(np.uint64) + np.uint64(1)
    mixed = (letters * np.uint64(0xBF58476D1CE4E5B9)) ^ (letters << np.uint64(29))
    most = int(sizes.max())
    sums = np.append(np.uint64(0), np.cumsum(mixed * _powers(most, BASE, 1 << 64)[pos]))
    less = sums[at] - sums[start] + (sums[end] - sums[at + 1]) * np.uint64(pow(BASE, -1, 1 << 64))
    own = sums[ends] - sums[ends - sizes]
    p = np.uint64(PRIME)
    sums = np.append(np.uint64(0), np.cumsum(letters * _powers(most, PRIME_BASE, PRIME)[pos] % p))
    check_less = (sums[at] - sums[start] + (sums[end] - sums[at + 1]) % p * np.uint64(pow(PRIME_BASE, -1, PRIME))) % p
    check_own = (sums[ends] - sums[ends - sizes]) % p
    one, two = np.searchsorted(at, one), np.searchsorted(at, two)
    n = sizes[line]
    whole = np.arange(0 if split else len(norms))
    return (
        np.concatenate((whole, line[one], line[two])),
        np.repeat([0, 1, 2], [len(whole), len(one), len(two)]),
        np.concatenate((_mixed(own, sizes)[whole], _mixed(less[one], n[one] - 1), _mixed(less[two], n[two], pos[at[two]]))),
        np.concatenate((check_own[whole], check_less[one], check_less[two])).astype(np.int64),
    )


def _lines(docs: DataFrame, characters: bool) -> DataFrame:
    """(k1, k2, o, th, pos, halves) of every line that isn't blank; k1 and k2 stand for its words.

    ``halves`` are hashes of 8 bytes that a line one edit apart shares one of.
    """
    names, kinds = ["k1", "k2", "o", "th", "pos", "halves"], "k1 long, k2 long, o long, th long, pos int, halves binary"

    def run(batches):
        for b in batches:
            keys, halves, of, pos = [], [], [], []
            for d, t in enumerate(b.column(2).to_pylist()):
                for p, w in enumerate(split_lines(t)):
                    n = len(w)
                    if not n:
                        continue
                    own, some = None, set()
                    # a blank more makes a line of LEAST_WORDS of one with a word less
                    if n >= LEAST_WORDS - characters:
                        own, some = _half_keys(w)
                    if characters and n < LEAST_WORDS:
                        own, more = _char_half_keys(" ".join(w))
                        some |= more
                    keys.append(own or _line_key(w))
                    halves.append(b"".join(some))
                    of.append(d)
                    pos.append(p)
            at, k = pa.array(of, pa.int32()), _longs(keys)
            cols = [pa.array(k[::2]), pa.array(k[1::2]), b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(halves, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("o", "th", "text").mapInArrow(released(run), kinds)


def _likely(lines: DataFrame) -> DataFrame:
    """(k1) of every line that is long enough for an edit and shares a half with another line; a few may come twice.

    A task that sees a half in several lines tells them at once and sends one of them alone to meet other tasks' lines,
    so a half's lines meet in no one task, however many there are.
    """

    def run(batches):
        held, n = [], 0
        for b in batches:
            each = b.column(1)
            counts = np.diff(np.frombuffer(each.buffers()[1], np.int32)[each.offset : each.offset + len(each) + 1]) // 8
            held.append((_longs(each.to_pylist()), np.repeat(b.column(0).to_numpy(), counts)))
            n += len(held[-1][0])
            if n >= COMBINE:
                yield combined(held)
                held, n = [], 0
        if n:
            yield combined(held)

    def combined(held):
        h, k1 = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((k1, h))
        h, k1 = h[by], k1[by]
        new = np.append(True, (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]))
        h, k1 = h[new], k1[new]
        first = np.append(True, h[1:] != h[:-1])
        counts = np.diff(np.append(np.flatnonzero(first), len(h)))
        known = np.unique(k1[np.repeat(counts > 1, counts)])
        sent = np.append(np.zeros(len(known), bool), np.ones(int(first.sum()), bool))
        cols = [pa.array(sent), pa.array(np.append(known, h[first])), pa.array(np.append(known, k1[first]))]
        return pa.RecordBatch.from_arrays(cols, names=["sent", "half", "k1"])

    rows = lines.select("k1", "halves").mapInArrow(released(run), "sent boolean, half long, k1 long").repartition("half").sortWithinPartitions("half")

    def meet(batches):
        half, k1, n = [], [], 0
        for b in batches:
            sent, h, k = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not sent.all():
                yield told(k[~sent])
            half.append(h[sent])
            k1.append(k[sent])
            n += len(half[-1])
            if n < MEETING:
                continue
            h, k = np.concatenate(half), np.concatenate(k1)
            cut = int(np.searchsorted(h, h[-1]))
            yield told(shared(h, k))
            if not cut:  # of a half with so many rows two lines stand for all
                one = int(np.argmax(k != k[0]))
                h, k = h[[0, one][: 1 + (one > 0)]], k[[0, one][: 1 + (one > 0)]]
            half, k1, n = [h[cut:]], [k[cut:]], len(h) - cut
        if n:
            yield told(shared(np.concatenate(half), np.concatenate(k1)))

    def shared(h, k):
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(starts, len(h)))
        return k[np.repeat(np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts), sizes)]

    def told(k):
        return pa.RecordBatch.from_arrays([pa.array(np.unique(k))], names=["k1"])

    return rows.mapInArrow(released(meet), "k1 long")


def _picked(docs: DataFrame) -> DataFrame:
    """(o, th, pos, norm) of the lines whose numbers are ``picked``."""

    def run(batches):
        for b in batches:
            rows = []
            for o, th, z, picked in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                each = split_lines(zstandard.decompress(z).decode("utf-8", "surrogatepass"))
                rows += [(o, th, p, " ".join(each[p])) for p in picked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["o", "th", "pos", "norm"])

    return docs.select("o", "th", "packed", "picked").mapInArrow(released(run), "o long, th long, pos int, norm string")


def _splits(lines: DataFrame) -> DataFrame:
    """The ``lines`` (o, th, pos, norm) of ``LEAST_WORDS`` words or more of which one letter may be another's blank.

    Without blanks the other has one letter less and shares the half of the line where that letter isn't. Each line
    gives both halves as the one with the letter (1) and as the other (2); those with a counterpart of the other kind
    are returned. Kinds are reduced before they move.
    """

    def run(batches):
        for b in batches:
            keys, of, kind = [], [], []
            for k, norm in enumerate(b.column(3).to_pylist()):
                words = norm.count(" ") + 1
                if words < LEAST_WORDS:
                    continue
                bare = norm.replace(" ", "")
                for is_it, m, n, gap in ((1, len(bare), words, 0), (2, len(bare) + 1, words - 1, 1)):
                    if n >= LEAST_WORDS:
                        seed, h = (m << 20 | n) << 1, m // 2
                        keys += [_digest(x.encode("utf-8", "surrogatepass"), seed + side) for side, x in enumerate((bare[:h], bare[h - gap :]))]
                        of += [k, k]
                        kind += [is_it, is_it]
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(_longs(keys)), pa.array(kind, pa.int32()), *(b.column(c).take(at) for c in range(3))], names=["key", "kind", "o", "th", "pos"])

    halves = stored(lines.select("o", "th", "pos", "norm").mapInArrow(released(run), "key long, kind int, o long, th long, pos int"), "halves")
    both = halves.groupBy("key").agg(F.bit_or("kind").alias("kinds")).where("kinds = 3")
    some = stored(halves.join(both, "key", "left_semi").select("o", "th", "pos").distinct(), "splits")
    drop(halves)
    return lines.join(some, ["o", "th", "pos"], "left_semi"), some


#: ``tag`` of a variant: check << 33 | role << 31 | line number; role 3 is a line that its task knows to be near an earlier one.
ROLE, CHECK = 31, 33


def _starts(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Where the group of equal variants changes, of rows in order."""
    return np.append(True, (key[1:] != key[:-1]) | (tag[1:] >> CHECK != tag[:-1] >> CHECK))


def _firsts(new: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of group, role and place: (row has a counterpart, its counterpart, row is the first of group and role).

    The counterpart of the line is the first that is it with one word more; of the line without a word, the first that is
    just that; of the same at its place, the first such.
    """
    n = len(new)
    head = np.append(True, new[1:] | (role[1:] != role[:-1]))
    group = np.cumsum(new)
    start = np.flatnonzero(new)[group - 1]
    heads = np.flatnonzero(head)
    mine = np.cumsum(head) - 1
    follows = np.append(heads[1:], n)[mine]  # the first row of the next role or group
    inside = np.minimum(follows, n - 1)
    other = np.where(role == 0, inside, np.where(role == 1, start, heads[mine]))
    has = np.where(role == 0, (follows < n) & (group[inside] == group) & (role[inside] == 1), np.where(role == 1, role[start] == 0, True))
    return has, other, head


def _variants(lines: DataFrame, characters: bool, split: bool) -> DataFrame:
    """(key, tag, o, th) of the variants that ``lines`` give; with ``split`` those for a letter that may be a blank.

    Roles: 0 is the line, 1 the line without a word or character, 2 the same at that place, for substitutions.
    """

    def run(batches):
        own, without, sizes, held, norms, chars = [], [], [], [], [], 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in range(3)])
            for norm in b.column(3).to_pylist():
                long = norm.count(" ") + 1 >= LEAST_WORDS
                key, found = _variant_keys(norm.encode("utf-8", "surrogatepass")) if long and not split else (bytes(16), [])
                own.append(key)
                without += found
                sizes.append(len(found))
                norms.append(norm)
                chars += characters * (len(norm) if long else 2 * len(norm))
            if 2 * len(without) + chars >= COMBINE:
                yield combined(own, without, sizes, held, norms)
                own, without, sizes, held, norms, chars = [], [], [], [], [], 0
        if own:
            yield combined(own, without, sizes, held, norms)

    def combined(own, without, sizes, held, norms):
        o, th, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, th, o))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes, own, without = np.array(sizes), _longs(own).reshape(-1, 2), _longs(without).reshape(-1, 2)
        each, long = np.repeat(rank, sizes), sizes > 0
        place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lines, roles = [rank[long], each, each], [int(long.sum()), len(each), len(each)]
        key = [own[long, 0], without[:, 0], _mixed(without[:, 0].copy(), place, np.repeat(sizes, sizes))]
        check = [own[long, 1], without[:, 1], without[:, 1]]
        role = np.repeat([0, 1, 2], roles)
        if characters:
            of, more, keys, checks = _char_keys(norms, split)
            lines, role, key, check = [*lines, rank[of]], np.concatenate((role, more)), [*key, keys], [*check, checks]
        line, key, check = np.concatenate(lines), np.concatenate(key), np.concatenate(check) & 0xFFFFFFF
        mark = check << 2 | role
        by = np.lexsort((line, mark, key))
        key, mark, line = key[by], mark[by], line[by]
        new = np.append(True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (line[1:] != line[:-1]))[: len(key)]  # of equal words one goes
        key, mark, line = key[new], mark[new], line[new]
        settled, first = np.zeros(len(order), bool), np.zeros(0, bool)
        if len(key):
            has, other, first = _firsts(_starts(key, mark << ROLE), mark & 3)
            earlier = np.flatnonzero(has & (line[other] < line))
            for a, b in set(zip(line[earlier].tolist(), line[other[earlier]].tolist(), strict=True)):
                settled[a] = settled[a] or near(norms[order[a]], norms[order[b]], characters)
        go, told = np.flatnonzero(first | ~settled[line]), order[settled]
        at = order[line[go]]
        cols = [np.append(_mixed(o[told], th[told], pos[told]), key[go]), np.append(3 << ROLE | pos[told].astype(np.int64), mark[go] << ROLE | pos[at]), np.append(o[told], o[at]), np.append(th[told], th[at])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "tag", "o", "th"])

    return lines.select("o", "th", "pos", "norm").mapInArrow(released(run), "key long, tag long, o long, th long")


def _candidates(lines: DataFrame, characters: bool) -> DataFrame:
    """(o, th, pos, bo, bth, bpos): lines with an earlier one of an equal variant; without it where they are known to be near."""
    rows, scratch = _variants(lines, characters, False), []
    if characters:
        some, table = _splits(lines)
        rows, scratch = rows.union(_variants(some, True, True)), [table]
    rows = rows.repartition("key").sortWithinPartitions("key", F.shiftright("tag", ROLE), "o", "th", "tag")
    low, kinds = (1 << ROLE) - 1, [pa.int64(), pa.int64(), pa.int32()]

    def meet(batches):
        held, n = [], 0
        for b in batches:
            cols = [b.column(c).to_numpy() for c in range(4)]
            told = cols[1] >> ROLE & 3 == 3
            if told.any():
                _, tag, o, th = (x[told] for x in cols)
                yield batch([pa.array(o), pa.array(th), pa.array((tag & low).astype(np.int32))] + [pa.nulls(len(o), x) for x in kinds])
                cols = [x[~told] for x in cols]
            held.append(cols)
            n += len(cols[0])
            if n < MEETING:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield pairs(cols if not cut else [x[:cut] for x in cols])
            # of a key with so many rows, in order, the first of each role stands for all
            rest = np.arange(cut, n) if cut else np.unique(cols[1] >> ROLE, return_index=True)[1]
            held, n = [[x[rest] for x in cols]], len(rest)
        if n:
            yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    def pairs(cols):
        key, tag = cols[:2]
        new = _starts(key, tag)
        many = ~(new & np.append(new[1:], True))
        key, tag, o, th = (x[many] for x in cols)
        if not len(key):
            return batch([pa.nulls(0, k) for k in kinds * 2])
        has, other, _ = _firsts(new[many], tag >> ROLE & 3)
        pos = (tag & low).astype(np.int32)
        after = (o > o[other]) | (o == o[other]) & ((th > th[other]) | (th == th[other]) & (pos > pos[other]))
        k = np.flatnonzero(has & after)
        return batch([pa.array(x[k]) for x in (o, th, pos)] + [pa.array(x[other[k]]) for x in (o, th, pos)])

    def batch(cols):
        return pa.RecordBatch.from_arrays(cols, names=["o", "th", "pos", "bo", "bth", "bpos"])

    found = stored(rows.mapInArrow(released(meet), "o long, th long, pos int, bo long, bth long, bpos int").distinct(), "candidates")
    drop(*scratch)
    return found


def removed_lines(docs: DataFrame, characters: bool = False) -> DataFrame:
    """(o, th, gone array<int>) for documents (o, th, text) that lose lines."""
    at = F.struct("o", "th", "pos")
    lines = stored(_lines(docs, characters), "all-lines")  # some 40 bytes a line: documents and places repeat
    firsts = stored(lines.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last")), "lines")
    # lines that share a half with another line; the others have no neighbour
    likely = stored(_likely(lines).distinct(), "likely")
    picked = firsts.join(likely, "k1").select("first.*").groupBy("o", "th").agg(F.collect_set("pos").alias("picked"))
    texts = stored(_picked(packed(docs).join(picked, ["o", "th"])).dropDuplicates(["o", "th", "pos"]), "neighbours")
    drop(likely)
    found = _candidates(texts, characters)
    pairs = found.where("bo is not null").select(at.alias("at"), F.struct(F.col("bo").alias("o"), F.col("bth").alias("th"), F.col("bpos").alias("pos")).alias("by"))
    norms = texts.select(at.alias("at"), "norm")
    pairs = pairs.join(norms, "at").join(norms.select(F.col("at").alias("by"), F.col("norm").alias("earlier")), "by")

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y, characters) for x, y in zip(a, b, strict=True)], dtype=np.bool_)

    told = found.where("bo is null").select(at.alias("first"))
    told = stored(pairs.where(within("norm", "earlier")).select(F.col("at").alias("first")).union(told).distinct(), "near")
    drop(found, texts)
    judged = firsts.join(told.withColumn("near", F.lit(True)), "first", "left").where("near or first <> last").drop("last")
    gone = lines.select("k1", "k2", at.alias("at")).join(judged, ["k1", "k2"]).where((F.col("at") != F.col("first")) | F.col("near"))
    gone = stored(gone.select("at.*").groupBy("o", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    drop(lines, firsts, told)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """``docs`` without the lines that are equal to, or one edit from, an earlier line; adds n_lines, n_removed.

    Earlier: in a document of smaller id, or higher up in the same one; lines are judged on the input, whether or not the
    earlier one itself goes. Blank lines stay. An edit is one of a word for lines of at least ``LEAST_WORDS`` words; with
    ``characters``, one of a character for all lines too, else shorter lines go only if equal. Null texts stay null, with no
    lines. Null ids come last; documents of one id go by a hash of their text, and rows with the same id and text are one
    document that comes out alike in each. Other columns are kept, whatever their names; columns n_lines and n_removed that
    are there already stay as they are. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    o, th = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(F.col(text_col).cast("string"))
    slim = docs.select(o.alias("o"), th.alias("th"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    o2, th2, o3, th3, zipped, gone, done = (fresh(x, docs.columns) for x in ("__o", "__th", "__o_gone", "__th_gone", "__packed", "__gone", "__cut"))
    lost = removed_lines(slim, characters).select(F.col("o").alias(o3), F.col("th").alias(th3), F.col("gone").alias(gone))
    out = packed(docs.withColumns({o2: o, th2: th, text_col: F.col(text_col).cast("string")}), text_col, zipped)
    out = out.join(lost, (F.col(o2) == F.col(o3)) & (F.col(th2) == F.col(th3)), "left")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(z: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for x, g in zip(z, gone, strict=True):
            if x is None:
                rows.append((None, 0, 0))
                continue
            each = zstandard.decompress(x).decode("utf-8", "surrogatepass").split("\n")
            drop = set() if g is None else set(g)
            rows.append(("\n".join(line for k, line in enumerate(each) if k not in drop), len(each), len(drop)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    out = out.withColumn(done, cut(zipped, gone))
    told = [c for c in ("n_lines", "n_removed") if c not in docs.columns]
    names = [F.col(f"{done}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*names, *(F.col(f"{done}.{c}").alias(c) for c in told))

"""Embedding, line and byte deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tempolake.llm import bcr_dedup, embedding_pq, line_dedup


def test_embeddings_are_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    rows = [(base[k % 12] + r.normal(size=16) * 0.3 * r.random()).tolist() for k in range(500)]
    rows += [[1e200 * c for c in rows[7]], [1e-200 * c for c in rows[8]], [1e200 * c for c in rows[0]]]
    rows += rows[:30] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [1.0, 2.0], [2 * x for x in rows[5]]]
    ids = [*range(len(rows))]
    random.Random(1).shuffle(ids)
    ids[3] = None
    ids[4] = ids[9]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, uid int")

    def good(v):
        return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)

    near = defaultdict(set)
    for a, x in enumerate(rows):
        for b in range(a):
            y = rows[b]
            if good(x) and good(y) and len(x) == len(y) and (u := np.array(x) / np.abs(x).max()) @ (v := np.array(y) / np.abs(y).max()) / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.95:
                near[a].add(b)
                near[b].add(a)
    want = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        c = min((ids[x] for x in seen if ids[x] is not None), default=None)
        want.append((ids[a], len(near[a]), c, ids[a] == c))
    for block in (2048, 40):
        monkeypatch.setattr(embedding_pq, "BLOCK", block)
        got = [tuple(x) for x in embedding_pq.near_duplicates(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert embedding_pq.near_duplicates(df.limit(0)).count() == 0


def _links(rows, cosine=0.95):
    x = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    return (x @ x.T >= cosine).sum(1) - 1


@pytest.mark.parametrize("block", [8192, 500])
def test_embeddings_of_one_cluster_over_many_lists(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_pq, "BLOCK", block)
    r = np.random.default_rng(8)
    centre, jitter = r.normal(size=16), 0.14 * np.repeat([1, 2], [2400, 600])[:, None]  # sqrt(3000) / 2: 27 lists
    rows = (centre + r.normal(size=(3000, 16)) * jitter).tolist()
    df = spark.createDataFrame([*enumerate(rows)], "vec_id long, embedding array<double>")
    got = {x.id: x.n_links for x in embedding_pq.near_duplicates(df).collect()}
    want = _links(rows)
    assert 500 < want.mean() < 2900
    assert [got[k] for k in range(3000)] == want.tolist()


def test_embeddings_of_every_length_link(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = []
    for dim, n in ((16, 400), (3, 120), (2, 30), (40, 1)):
        base = r.normal(size=(10, dim))
        rows.append([(base[k % 10] + r.normal(size=dim) * 0.2).tolist() for k in range(n)])
    rows[2] += [[1.0, 2.0], [2.0, 4.0]]
    want = [n for x in rows for n in _links(x).tolist()]
    df = spark.createDataFrame([*enumerate(v for x in rows for v in x)], "vec_id long, embedding array<double>")
    for block in (8192, 40):
        monkeypatch.setattr(embedding_pq, "BLOCK", block)
        got = {x.id: x.n_links for x in embedding_pq.near_duplicates(df).collect()}
        assert [got[k] for k in range(len(want))] == want


@pytest.mark.parametrize("combine, meeting", [(400_000, 100_000), (300, 1)])
def test_line_dedup_is_brute_force(spark, monkeypatch, combine, meeting):
    monkeypatch.setattr(line_dedup, "COMBINE", combine)
    monkeypatch.setattr(line_dedup, "MEETING", meeting)
    r = random.Random(2)
    vocab = "a b c d e f g h".split()
    pool = [" ".join(r.choice(vocab) for _ in range(r.randrange(7, 12))) for _ in range(25)]

    def line():
        w = r.choice(pool).split()
        k = r.randrange(len(w))
        how = r.randrange(6)
        if how == 0:
            w[k] = r.choice(vocab)
        elif how == 1:
            del w[k]
        elif how == 2:
            w.insert(k, r.choice(vocab))
        return r.choice(["  ", ""]) + " ".join(w).upper() if how == 3 else " ".join(w)

    docs = [(k, "\n".join(r.choice([line(), line(), "", "short one", f"own {k} {r.random()} x y z u v w"]) for _ in range(r.randrange(0, 8)))) for k in range(60)]
    docs += [(70, None), (71, ""), (None, docs[5][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id long, text string, o int, n_lines int, packed int, __o int")
    rows = sorted({(10**9 if i is None else i, t) for i, t in docs if t is not None})
    flat = [(i, t, p, " ".join(x.lower().split())) for i, t in rows for p, x in enumerate(t.split("\n"))]

    def edits(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    gone = defaultdict(set)
    for k, (i, t, p, x) in enumerate(flat):
        for j in range(k):
            y = flat[j][3]
            a, b = x.split(), y.split()
            if x and (x == y or (min(len(a), len(b)) >= 8 and edits(a, b) <= 1)):
                gone[i, t].add(p)
                break
    want = []
    for i, t in docs:
        g = gone[10**9 if i is None else i, t] if t is not None else set()
        want.append((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g), 1, 2, 3, 4, len(g)))
    got = [tuple(x) for x in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[-1] for x in got) > 20
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("combine, meeting", [(400_000, 100_000), (300, 1)])
def test_line_dedup_by_characters_is_brute_force(spark, monkeypatch, combine, meeting):
    monkeypatch.setattr(line_dedup, "COMBINE", combine)
    monkeypatch.setattr(line_dedup, "MEETING", meeting)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 7)))
    pool = [" ".join(word() for _ in range(r.choice([1, 2, 5, 6, 7, 7, 8, 8, 9, 14]))) for _ in range(40)] + ["春眠不覚暁処処聞啼鳥夜来風雨声", "Contact us", "日"]

    def line():
        x = r.choice(pool)
        k = r.randrange(len(x))
        blanks = [p for p, c in enumerate(x) if c == " "]
        if blanks and r.random() < 0.5:
            k = r.choice(blanks)
        return r.choice([x, x[:k] + r.choice("abx花 ") + x[k + 1 :], x[:k] + x[k + 1 :], x[:k] + r.choice("abx花 ") + x[k:]])

    docs = [(k, "\n".join(r.choice([line(), line(), line(), ""]) for _ in range(r.randrange(0, 9)))) for k in range(70)]
    docs += [(80, "foo bar"), (81, "foobar"), (82, "foo-bar"), (83, "one two three four five six seven eight nine"), (84, "one two-three four five six seven eight nine"), (85, "one two three four five six seven eightnine")]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flat = [(i, p, " ".join(x.lower().split())) for i, t in sorted(docs) for p, x in enumerate(t.split("\n"))]

    def edits(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    gone = defaultdict(set)
    for k, (i, p, x) in enumerate(flat):
        for _, _, y in flat[:k]:
            a, b = x.split(), y.split()
            if x and y and abs(len(x) - len(y)) < 9 and (x == y or (min(len(a), len(b)) >= 8 and edits(a, b) <= 1) or (abs(len(x) - len(y)) < 2 and edits(x, y) <= 1)):
                gone[i].add(p)
                break
    got = {x.doc_id: (x.n_removed, x.text) for x in line_dedup.dedup_lines(df, characters=True).collect()}
    assert got == {i: (len(gone[i]), "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])) for i, t in docs}
    assert all(got[k][0] == 1 for k in (81, 82, 84, 85))
    assert sum(x[0] for x in got.values()) > sum(x.n_removed for x in line_dedup.dedup_lines(df).collect())


def test_lines_of_any_text_column(spark):
    df = spark.createDataFrame([(1, "Same line\nown", 7), (2, "Same line\n" + "x" * 300_000, 8), (3, None, 9)], "id long, body string, text int")
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(df, "id", "body", characters=True).collect())
    assert got == [(1, "Same line\nown", 7, 2, 0), (2, "x" * 300_000, 8, 2, 1), (3, None, 9, 0, 0)]


@pytest.mark.parametrize("memory, block", [(1 << 20, 1 << 18), (10, 1 << 18), (10, 7), (10, 64)])
def test_column_index_is_the_suffix_order(monkeypatch, tmp_path, memory, block):
    monkeypatch.setattr(bcr_dedup, "MEMORY_SUFFIXES", memory)
    monkeypatch.setattr(bcr_dedup, "FILE_BLOCK", block)
    r = random.Random(7)
    segs = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randrange(1, 30))) for _ in range(40)]
    segs += [segs[0], b"a" * 25]
    name, lcp = bcr_dedup.column_index(segs, f"file:{tmp_path}")
    assert not list(tmp_path.iterdir())
    got = [segs[x // bcr_dedup.OFFSETS][x % bcr_dedup.OFFSETS :] for x in name.tolist()]
    assert got == sorted(got) and len(got) == sum(map(len, segs)) + len(segs)

    def common(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    assert lcp.tolist()[1:] == [common(a, b) for a, b in zip(got, got[1:], strict=False)]


def test_hot_minimizers_keep_every_place(spark):
    # one minimizer: a task's 250,000 places, one of them sent, and at the end another task's only one
    places, was = 250_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.range(0, places, 1, 1).selectExpr("7L as h", "id as k", f"4L + if(id <> {places - 1}, 2L, 0L) + if(id in (5, {places - 1}), 1L, 0L) as tag")
        assert bcr_dedup._repeated(rows).select("k").distinct().count() == places
        # one place that many tasks tell is one
        rows = spark.range(3).selectExpr("7L as h", "5L as k", "(9L << 16) + 5L as tag").union(spark.range(1).selectExpr("8L", "5L", "5L")).union(spark.range(1).selectExpr("8L", "5L", "(1L << 16) + 5L"))
        assert sorted((x.h, x.start) for x in bcr_dedup._repeated(rows).collect()) == [(8, 0), (8, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_windows_that_repeat_within_one_run(spark):
    # texts of a period each, which no other text shares: their repeats lie in one run of windows, or in few
    r = random.Random(8)
    texts = []
    for period in [*range(1, 70), 99, 100, 140]:
        for more in (0, 1, 7, 61):
            unit = "".join(chr(r.randrange(0xA1, 0x800)) for _ in range(period // 2)) + chr(r.randrange(33, 127)) * (period % 2)
            whole = (unit * 300).encode()[: 100 + period + more - 1]
            texts.append("".join(r.choice("QRSTUVW") for _ in range(r.randrange(60))) + whole.decode(errors="ignore") + f"{period} {more}")
    want, seen = [], set()
    for k, t in enumerate(x.encode() for x in texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(t[s : s + 100])
        want.append((k, int(gone.sum())))
    got = bcr_dedup.dedup_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((x.id, x.n_removed) for x in got.select("id", "n_removed").collect()) == want
    assert sum(n > 0 for _, n in want) > 150


@pytest.mark.parametrize("most, memory, remembered", [(20_000, 400_000, 50_000), (20_000, 100, 50_000), (20_000, 400_000, 1), (1, 400_000, 50_000), (1, 400_000, 1)])
def test_byte_dedup_is_brute_force(spark, monkeypatch, most, memory, remembered):
    monkeypatch.setattr(bcr_dedup, "MOST_SEGMENTS", most)
    monkeypatch.setattr(bcr_dedup, "MEMORY_SUFFIXES", memory)
    monkeypatch.setattr(bcr_dedup, "FILE_BLOCK", 1000)
    monkeypatch.setattr(bcr_dedup, "REMEMBERED", remembered)
    r = random.Random(6)
    shared = ["".join(r.choice("abcdé ") for _ in range(r.randrange(90, 400))) for _ in range(6)]
    docs = []
    for k in range(50):
        own = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randrange(0, 150)))
        s = r.choice(shared)
        docs.append((k, own() + s[r.randrange(0, 50) :] + own() + r.choice(["", r.choice(shared), "z" * r.randrange(90, 260), "xy" * 90]) + own()))
    docs += [(60, docs[3][1]), (61, None), (62, ""), (63, "q" * 99), (64, "q" * 99), (65, "w" * 100), (66, "w" * 100), (None, docs[8][1]), (3, docs[3][1]), (3, docs[4][1] + docs[5][1]), (70, docs[9][1] * 300), (None, "n" * 120 + docs[2][1]), (None, "n" * 150)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, th int")
    rows = sorted({(10**9 if i is None else i, (t or "").encode()) for i, t in docs}, key=lambda x: (x[0], hashlib.sha256(x[1]).digest()))
    seen, gone = set(), {}
    for d in rows:
        out = np.zeros(len(d[1]), bool)
        for s in range(len(d[1]) - 99):
            w = d[1][s : s + 100]
            if w in seen:
                out[s : s + 100] = True
            seen.add(w)
        gone[d] = out
    want = []
    for i, t in docs:
        b = (t or "").encode()
        g = gone[10**9 if i is None else i, b]
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        want.append((i, len(b), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(x.id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in bcr_dedup.dedup_bytes(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bcr_dedup.dedup_bytes(df.limit(0)).count() == 0


def test_known_windows_of_a_hot_minimizer_go_as_runs(spark, monkeypatch):
    monkeypatch.setattr(bcr_dedup, "MOST_SEGMENTS", 5)
    rows, indexed = [], bcr_dedup._indexed
    monkeypatch.setattr(bcr_dedup, "_indexed", lambda pieces, folder: rows.append(pieces.count()) or indexed(pieces, folder))
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh") for _ in range(300))
    docs = [(k, "".join(r.choice("ijklmnop") for _ in range(150)) + passage) for k in range(200)]
    got = bcr_dedup.dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # a few letters before the passage may be alike
    assert all(300 <= x.n_removed <= 310 and x.n_spans == 1 if x.id else x.n_removed == 0 for x in got) and len(got) == 200
    # 201 windows of the passage and those of its context that share a minimizer with it
    assert rows[0] < 100 * len(docs)

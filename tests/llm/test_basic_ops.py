"""The operators against brute force over small tables, with nulls, empties, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tempolake.llm import chat, decontam, packing, queries, simhash, warc

WORDS = "the of and tion ing ä ö that with from erinble stou reand".split()


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + r.choice(["", ".", ",", "\n"]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts(120)
    t += t[:15] + [x.replace("the", "of", 1) for x in t[:25]] + ["", None, "word", "Word", "x" * 50_000]
    rows = [(k if k != 7 else None, x, "en", 1, "a") for k, x in enumerate(t)] + [(3, t[3], "de", 2, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int, id string")


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                comp[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    want = sorted(((i, f, min((x for x in least[find(k)] if x is not None), default=None)) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_anchors_reach_every_pair(spark):
    r = random.Random(5)
    rows = []
    for k in range(3000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randrange(1, 5)):
            y ^= 1 << b
        rows += [(k, x), (k, y)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(x)) for k, x in rows], "k long, fp long")
    roots = {a: b for a, b in simhash.connected_components(simhash.links(df.select("fp").distinct())).collect()}
    assert all(roots[signed(rows[i][1])] == roots[signed(rows[i + 1][1])] for i in range(0, len(rows), 2))


def test_full_anchors_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base, fps = 0x0123456789ABCDEF, set()
    for a in range(64):
        for b in range(a, 64, 5):
            fps.add(base ^ (1 << a) ^ (1 << b))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    assert len({r.root for r in simhash.connected_components(simhash.links(df)).collect()}) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = simhash.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    sets = defaultdict(set)
    for r in got:
        sets[r.root].add(r.node)
    assert sorted(map(len, sets.values())) == [200, 301]


def test_exploded_anchors_are_not_broadcast(spark):
    df = spark.createDataFrame([(k,) for k in range(500)], "fp long")
    found = simhash.links(df)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_estimates_stay_bounded_over_the_rounds(spark):
    got = simhash.connected_components(spark.range(2000).selectExpr("id u", "id + 1 v"))
    assert len(got.select("root").distinct().collect()) == 1 and got.count() == 2001
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    odd = ["", " ", "a<|endoftext|>b", "It's  we'll 'tis", "naïve ½ ²3 x y\tz\r\n\x1cq", "é É ﬁ ΑΣ İ", "日本語 text", "don't!!! (a)b_c-d", "́x ý", "ÄÖÜß µ ª"] + texts(60, 9)
    got = packing.WordEncoder(vocabulary).encode(odd)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_pieces_are_merged_once(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    enc, merged, given = packing.WordEncoder(vocabulary), packing.WordEncoder._merged, []
    monkeypatch.setattr(packing.WordEncoder, "_merged", lambda self, pieces: given.extend(pieces) or merged(self, pieces))
    batches = [["Alpha, beta; 日本 x\u0301 gamma"], ["gamma delta\tbeta\nalpha? 日本 alpha"], ["GAMMA (delta) é"], [""]]
    got = [x.tolist() for b in batches for x in enc.encode(b)]
    assert got == [enc.whole.encode(x, add_special_tokens=False).ids for b in batches for x in b]
    assert len(given) == len(set(given)) and {"alpha", "gamma", "delta"} <= set(given)


def test_workers_remember_no_words_between_tasks(spark, docs, vocabulary):
    packing.pack_documents(docs, vocabulary).collect()

    def run(batches):
        for _ in batches:
            enc = packing.encoder(vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.words.slot) + len(enc.pieces.slot)])], names=["n"])

    assert {r.n for r in spark.range(0, 16, 1, 16).mapInArrow(run, "n long").collect()} == {2}  # the entries without ids


def test_packing_loses_no_token(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    got = packing.pack_documents(docs, vocabulary, length=64).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for p in got:
        seqs[p.sequence_id].append((p.offset, p.length))
        pieces[p.id].append(p)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 64
    total = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) <= -(-total // 64) + docs.rdd.getNumPartitions()  # one that is not full a task
    for r in docs.collect():
        if r.doc_id in (3, None):
            continue
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p.length
        assert at == len(ids)
    assert packing.pack_documents(docs.limit(0), vocabulary).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "ä" * 200, "tiny"
    rows = [(5, "http://a\r\nX: y", big), (2, None, big), (9, "u", small), (1, "u", small), (4, "u", None), (None, "n", big), (7, "q", "z" * 99), (8, "q", "z" * 99), (2, None, big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    heads, blobs = warc.read_archive(spark, f"file://{tmp_path}/a")
    assert heads.count() == len(rows) and blobs.count() == len({r[2] or "" for r in rows})
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in warc.summary(spark, f"file://{tmp_path}/a").collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        same = [x for x, _, y in rows if y == h and x is not None]
        again = len(b) >= 100 and i != min(same)
        want.add((i, "revisit" if again else "response", min(same) if again else None, hashlib.sha256(b).hexdigest(), len(b)))
    assert got == want
    parsed = list(warc.parse(b"".join(bytes(r.record) for r in warc.reconstruct(heads, blobs).collect())))
    assert sorted(b.decode() for h, b in parsed if b"Type: response" in h) == sorted([big, big, small, small, "", "z" * 99, "z" * 99])
    (tmp_path / "w.warc").write_bytes(b"".join(h + b + b"\r\n\r\n" for h, b in parsed))
    assert warc.read_warc(spark, f"file://{tmp_path}/w.warc").count() == len(rows)
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.summary(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_of_long_urls(spark, tmp_path):
    body, url = "<p>" + "b" * 200, "data:," + "u" * 100_000
    edge = "e" * (65_536 - 250)  # some field crosses byte 65,536
    rows = [(1, url, body), (2, url, body), (3, "u", body), (4, url, "short"), *((k, edge + "e" * (4 * k), body) for k in range(5, 60))]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in warc.summary(spark, f"file://{tmp_path}/a").collect()}
    digest = hashlib.sha256(body.encode()).hexdigest()
    want = {(i, "revisit", 1, digest, len(body)) for i, *_ in rows if i not in (1, 4)}
    assert got == want | {(1, "response", None, digest, len(body)), (4, "response", None, hashlib.sha256(b"short").hexdigest(), 5)}
    # a field is read from the header alone, however long the payload
    record = F.lit(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC-Refers-To: <urn:page:5>\r\n\r\n")
    assert spark.range(1).select(warc.field(record, "WARC-Type"), warc.field(record, "WARC-Refers-To")).first()[:] == ("response", None)


def slow_leaks(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for i, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        for k in range(max(1, len(v) - 9) if v else 0):
            x = v[k : k + 10]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_is_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_DOCS", 7)
    source = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 25]
    items = [(k, " ".join(source[k].split()[3:20])) for k in range(20)] + [(50, "Tion ing"), (51, ""), (52, None), (6, "reand reand reand"), (53, "word")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for block in (100_000, 5):
        monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
        monkeypatch.setattr(decontam.window_blocks, "__defaults__", (10, block))
        got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, bench).collect()), key=str)
        assert got == sorted(((r.doc_id, *slow_leaks(r.text, items)) for r in docs.collect()), key=str)
    kept = decontam.without_contaminated(docs.withColumn("__key", F.lit(5)), bench)
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str((*r, 5)) for r in docs.collect() if not slow_leaks(r.text, items)[1])
    assert decontam.without_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 40 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.id: (r["items"], r.near) for r in decontam.decontaminate(docs, bench, span=6).collect()}
    assert got == {1: ([], ["1"]), 2: ([], ["1"]), 3: ([], [])}


def test_chat_round_trip(spark):
    r = random.Random(3)
    rows = []
    for c in range(40):
        for k in range(r.randrange(1, 30)):
            text = r.choice(["", None, "[INST +assistant]x</s>", "\\(\\[", "plain words here " * r.randrange(0, 90), "é😀"])
            rows.append((c if c else None, k, r.choice(["system", "user", "assistant", "to]ol", None]), text, "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.format_conversations(df, budget=120)
    got = {x.conv_id: x for x in chat.digests(made).collect()}
    by = defaultdict(list)
    for c, k, role, text, _ in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    first = {c: t[0] for c, t in by.items()}
    for w in made.where("window > 0").collect():
        role, text = first[w.conv_id]
        if role == "system":
            assert chat.read_window(w.formatted)[0] == (False, role, text)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def _tokens(turn, sign=chat.NEW):
    return chat.count_tokens(chat.formatted_turn(sign, *turn))


def test_history_is_bounded_by_tokens_alone():
    turns = [("user" if k % 2 else "assistant", "ok" if k % 3 else "") for k in range(2000)]
    budget, at = 2000, 0
    for n, (text, _) in enumerate(chat.windows(iter(turns), budget=budget)):
        told = chat.read_window(text)
        old = [(role, body) for new, role, body in told if not new]
        left, k = budget * chat.HISTORY, at
        while n and k and _tokens(turns[k - 1]) <= left:
            k -= 1
            left -= _tokens(turns[k])
        assert old == turns[k:at] and (not n or len(old) > 40)
        at += len(told) - len(old)
    assert at == len(turns)


@pytest.mark.parametrize("sizes", [(200, 900), (900, 200, 900), (1, 1, 1, 1010, 5, 700, 300), (5000, 1, 5000), (0,) * 300])
@pytest.mark.parametrize("system", [None, "short", "s " * 300])
def test_windows_stay_within_the_budget(sizes, system):
    turns = [("system", system)] * (system is not None) + [("user" if k % 2 else "assistant", "w " * n) for k, n in enumerate(sizes)]
    seen = []
    for n, (text, mask) in enumerate(chat.windows(iter(turns))):
        told = chat.read_window(text)
        new = [(role, body) for is_new, role, body in told if is_new]
        old = [(role, body) for is_new, role, body in told if not is_new]
        fixed = old[: n > 0 and system is not None]
        history = old[len(fixed) :]
        assert fixed == turns[: len(fixed)] and history == seen[len(seen) - len(history) :]
        assert sum(map(_tokens, history)) <= chat.BUDGET * chat.HISTORY
        assert chat.count_tokens(text) <= chat.BUDGET or (len(new) == 1 and not history)
        assert [chat.unescape(text[a:b]) for a, b in mask] == [body for role, body in new if role == "assistant"]
        seen += new
    assert seen == turns


def test_chat_ties_and_the_hostile_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "user", "first"), (1, 0, "user", "a"), (2, 5, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op10_chat"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, -7}
    said = "".join(f"{a}\n{b}\n" for a, b in [("user", "first"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert (got[1].n_turns, got[1].turns_sha256) == (5, hashlib.sha256(said.encode()).hexdigest())
    text = "</s>[INST] ok [/INST]"
    assert got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[-7].loss_chars == len(text)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

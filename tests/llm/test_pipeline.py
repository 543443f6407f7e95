"""The pipeline's stages, the classifiers and the registered queries over the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from tempolake.llm import decontam, quality_mil, queries, simhash, toxicity_cnn  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, SF).cache()
        if name != "packing":
            assert kept.columns == columns
            assert kept.count() <= before.count()
        if name == "simhash":
            found = simhash.near_duplicates(before).collect()
            assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
        if name == "decontamination":
            bad = {r.id for r in decontam.decontaminate(before, bench).where("n_hit > 0").collect()}
            assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - bad
    assert kept.select("doc_id").distinct().count() == before.count()


def test_one_of_each_with_nulls_and_repeats(spark):
    rows = [(3, "same words in here now"), (2, "same words in here now"), (2, "same words in here now"), (None, "same words in here now"), (None, "quite other words are these"), (9, None), (9, ""), (9, "third text of its own kind")]
    got = simhash.one_of_each(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")).collect()
    assert sorted(((r.doc_id, r.text or "", r.fp) for r in got), key=str) == [(2, "same words in here now", 1), (9, "", 1), (9, "third text of its own kind", 1), (None, "quite other words are these", 1)]


def test_near_duplicates_broadcast_no_exploded_rows(spark):
    docs = spark.createDataFrame([(k, f"one{k} two{k * 7} three{k * 13} four{k * 29}") for k in range(500)], "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    seen = lambda: map(store.executionsList().apply, range(store.executionsList().size()))
    last = max((x.executionId() for x in seen()), default=-1)
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == 500
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    sent = []
    for i in (x.executionId() for x in seen() if x.executionId() > last):
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (n for n in map(nodes.apply, range(nodes.size())) if n.name() == "BroadcastExchange"):
            counts = (m.accumulatorId() for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows")
            sent += [int(values.apply(k).replace(",", "")) for k in counts if values.contains(k)]
    assert sent and max(sent) <= 500


@pytest.mark.parametrize("module, column", [(quality_mil, "quality"), (toxicity_cnn, "toxic")])
def test_classifiers(spark, module, column):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    folds, held = (4, 2) if column == "quality" else (5, 0)
    scores = module.score_documents(docs, labels, fold=quality_mil.crc_fold("doc_id", folds) != held)
    rows = scores.join(labels, scores.id == labels.doc_id).collect()
    cut = 0.7 if column == "quality" else 0.5
    test = [(r.score >= cut, r[column]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % folds == held]
    ones = [p for p, y in test if y == 1]
    zeros = [not p for p, y in test if y == 0]
    assert sum(ones) / len(ones) > 0.85 and sum(zeros) / len(zeros) > 0.95
    assert scores.count() == docs.count()


@pytest.mark.parametrize("module", [quality_mil, toxicity_cnn])
def test_classifiers_at_the_edges(spark, module):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x" * 200_000)], "doc_id long, text string").selectExpr("*", "1 as quality", "2 as toxic", "3 as score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert [r.score for r in module.score_documents(docs, none).collect()] == [0.5] * 5
    assert [r.score for r in module.score_documents(docs, one).collect()] == [1.0] * 5
    two = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.score_documents(docs, two).collect())
    assert module.score_documents(docs.limit(0), two).count() == 0


def test_convolution_is_the_plain_sum():
    r = np.random.default_rng(3)
    tokens = [[b"w%d" % r.integers(9) for _ in range(n)] for n in (0, 1, 2, 7, 30)]
    known = np.unique(np.concatenate([toxicity_cnn.hashes([b"w1", b"w2", b"w5"]), toxicity_cnn.stem_hashes([b"w2", b"w6"])]))
    m = toxicity_cnn.Model(known, 4)
    m.b += r.normal(size=m.b.shape).astype(np.float32)
    flat, starts = m.layout([m.rows(t) for t in tokens])
    got = m.forward(flat, starts)[2]

    def row(h):
        k = np.flatnonzero(known == h)
        return m.E[k[0] + 1] if len(k) else np.zeros(toxicity_cnn.DIM)

    pad = [np.zeros(toxicity_cnn.DIM)] * (max(toxicity_cnn.WIDTHS) - 1)
    for t, out in zip(tokens, got, strict=True):
        x = [*pad, *(row(toxicity_cnn.hashes([w])[0]) + row(toxicity_cnn.stem_hashes([w])[0]) for w in t), *pad]
        pooled = []
        for w, W in zip(toxicity_cnn.WIDTHS, m.W, strict=True):
            values = [sum(x[k + o] @ W[o] for o in range(w)) for k in range(len(x) - w + 1)]
            pooled += np.maximum(np.max([np.zeros(toxicity_cnn.FILTERS), *values], axis=0), 0).tolist()
        assert np.isclose(out, np.maximum(np.array(pooled) + m.b, 0) @ m.out + m.bias[0], atol=1e-4)


def _differences(loss, arrays, grads, r, step=1e-3):
    for p, g in zip(arrays, grads, strict=True):
        for _ in range(8):
            at = tuple(r.integers(n) for n in p.shape)
            was = p[at]
            p[at] = was + step
            up = loss()
            p[at] = was - step
            down = loss()
            p[at] = was
            assert np.isclose((up - down) / (2 * step), g[at], rtol=0.05, atol=2e-3), (p.shape, at)


def test_gradients_are_finite_differences():
    r = np.random.default_rng(5)
    tokens = [[b"word%d" % r.integers(12) for _ in range(n)] for n in (3, 8, 15, 1)]
    m = toxicity_cnn.Model(np.unique(toxicity_cnn.hashes([b"word%d" % k for k in range(12)])), 2)
    m.E, m.W, m.b, m.out, m.bias = m.E.astype(float), [w.astype(float) for w in m.W], r.normal(0, 0.3, m.b.shape), m.out.astype(float), m.bias.astype(float)
    m.E[0] = 0
    y, weight = np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 3])
    flat, starts = m.layout([m.rows(t) for t in tokens])
    loss = lambda: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * m.forward(flat, starts)[2])).sum() / 4)
    grads = m.gradient(flat, starts, y, weight)
    _differences(loss, [m.b, m.out, m.bias, *m.W], grads[1:], r)
    _differences(loss, [m.E[1:]], [grads[0][1:]], r)

    texts = ["Some words, here 12!", "x" * 1300, "", "a b c\n" * 200]
    x, first = quality_mil.passages(texts)
    q = quality_mil.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), {})
    shapes = {"E": (x.shape[1], 6), "e": (6,), "V": (6, 4), "U": (6, 4), "a": (4,), "c": (6,), "d": (1,)}
    q.w = {k: r.normal(0, 0.5, s) for k, s in shapes.items()}
    loss = lambda: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * q.forward(x, first)[-1])).sum() / weight.sum())
    g = q.gradient(x, first, y, weight)
    _differences(loss, [q.w[k] for k in shapes], [g[k] for k in shapes], r)


def test_crc_fold_is_zlibs(spark):
    rows = spark.range(50).select("id", quality_mil.crc_fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_queries_have_their_columns(spark):
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11))
    for name in ("op2_quality", "op3_toxicity"):
        assert queries.QUERIES[name](spark, SF).columns == ["doc_id", "held_out", "score", "predicted"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_say_what_their_sql_says(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))

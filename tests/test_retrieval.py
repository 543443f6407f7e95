"""Retrieval, ranking metrics, the graph, the report and streaming, over small hand-made tables."""

import json
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempolake.operators import evaluation, graph, loss, query_sets, relational, retrieval, similarity
from tempolake.plans import report
from tempolake.streaming import ingest

DOCS = [("a", "fork knight tactics in the Sicilian Defense"), ("b", "back rank mate in the French Defense endgame"), ("c", "hanging piece in the Sicilian Defense Najdorf")]


def test_tokens_and_bm25(spark):
    assert spark.range(1).select(retrieval.tokens(F.lit("Nxd5! (B02) -- Alekhine's")).alias("t")).first().t == ["nxd5", "b02", "alekhine", "s"]
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    q = spark.createDataFrame([(1, "Sicilian fork"), (2, "zzz"), (3, "the the")], "qid int, text string")
    got = {(r.qid, r.doc_id): r.score for r in retrieval.bm25(docs, q).collect()}
    assert math.isclose(got[1, "a"], 1.481129, abs_tol=1e-6) and math.isclose(got[1, "c"], 0.479818, abs_tol=1e-6)
    assert (1, "b") not in got and not [k for k in got if k[0] == 2] and all(v >= 0 for v in got.values())


def ranking(spark, names):
    return spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(names)], "qid int, doc_id string, rank int")


def test_fusion(spark):
    got = [(r.doc_id, r.score) for r in retrieval.reciprocal_rank_fusion({"p": ranking(spark, "xy"), "q": ranking(spark, "yz")}).orderBy("rank").collect()]
    assert [d for d, _ in got] == ["y", "x", "z"]
    assert all(math.isclose(s, want, abs_tol=1e-9) for (_, s), want in zip(got, (1 / 62 + 1 / 61, 1 / 61, 1 / 62), strict=True))


@pytest.mark.parametrize("hits, rel, k, want", [("axb", "abcd", 3, {"recall": 0.5}), ("axb", "ab", 3, {"precision": 2 / 3}), ("xya", "a", 10, {"rr": 1 / 3}), ("x", "a", 10, {"rr": 0.0, "hit": 0}), ("abx", "ab", 3, {"ndcg": 1.0}), ("xa", "a", 2, {"hit": 1}), ("ab", "", 3, {"recall": None, "ndcg": None})])
def test_metrics(spark, hits, rel, k, want):
    q = spark.createDataFrame([(1,)], "qid int")
    qrels = spark.createDataFrame([(1, d) for d in rel], "qid int, doc_id string")
    r = evaluation.ir_metrics(q, ranking(spark, hits), qrels, k).first()
    for name, x in want.items():
        assert r[name] == x or math.isclose(r[name], x)


def test_spearman(spark):
    cases = {"up": ([1, 2, 3, 4, 5], [1, 4, 9, 16, 25], 1), "down": ([1, 2, 3], [3, 2, 1], -1), "ties": ([1, 1, 2, 2], [1, 1, 2, 2], 1), "single": ([1], [1], None), "flat": ([1, 2, 3], [5, 5, 5], None)}
    rows = [(k, float(a), float(b)) for k, (x, y, _) in cases.items() for a, b in zip(x, y, strict=True)]
    got = {r.k: r.rho for r in evaluation.spearman(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()}
    for k, (_, _, want) in cases.items():
        assert got[k] is None if want is None else math.isclose(got[k], want)


def test_relational(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (1, 3, "a"), (2, 9, "z"), (None, 1, "n")], "k int, o int, v string")
    assert sorted(map(tuple, relational.distinct_on(df, ["k"], ["o"]).collect()), key=str) == [(1, 3, "a"), (2, 9, "z"), (None, 1, "n")]
    one = evaluation.temporal_split(df.where("k = 2"), ["k"], ["o"]).first()
    assert one.split == "test"


@pytest.fixture(scope="module")
def corpus(spark):
    games = spark.createDataFrame([("g1", "Me", "white", "bob_1", "Sicilian Defense: Najdorf", "B90", 1.0, "2024-01-01"), ("g2", "Me", "black", "Carl", "Sicilian Defense: Najdorf", "B91", 0.0, "2024-01-02"), ("g3", "Me", "white", "Carl", "French Defense", "C00", None, "2024-01-03")], "game_id string, subject string, subject_color string, opponent string, opening string, eco string, subject_score double, date string").withColumns({"subject_elo": F.lit(1500), "url": F.lit("u")})
    k1, k2, k3 = "8/5k2/6p1/8/8/6P1/5K2/8 w - -", "8/4k3/6p1/8/8/6P1/5K2/8 w - -", "8/5k2/1p6/8/8/6P1/5K2/8 w - -"
    rows = [("g1", 9, k1, "white", True, 300, None, "blunder"), ("g1", 10, k2, "black", False, 150, 20, "mistake"), ("g2", 10, k2, "black", True, 200, 30, "mistake"), ("g3", 2, k3, "black", False, 120, 10, "book"), ("g3", 11, k1, "white", True, 10, 10, "ok")]
    moves = spark.createDataFrame(rows, "game_id string, ply int, pos_key string, color string, is_subject_move boolean, cp_loss int, eval_before_cp int, judgment string").withColumns({"san": F.lit("Kf3"), "best_move_san": F.lit("Ke3"), "move_number": F.lit(5)})
    positions = moves.select("pos_key").distinct().withColumns({"fen": F.concat("pos_key", F.lit(" 0 40")), "phase": F.lit("endgame"), "seen_count": F.lit(1)})
    themes = spark.createDataFrame([("g1", 9, "hanging_piece"), ("g1", 9, "fork"), ("g1", 10, "fork"), ("g2", 10, "fork")], "game_id string, ply int, theme string")
    return games, moves, positions, themes


def test_graph(spark, corpus):
    games, moves, positions, themes = corpus
    nodes, edges = graph.build(games, moves, positions, themes)
    nodes, edges = nodes.cache(), edges.cache()
    count = {r.name: r.n for r in graph.stats(nodes, edges).where("what = 'edge'").collect()}
    assert set(count) == {"in_family", "has_eco", "plays", "leads_to", "blunders_at", "exhibits", "struggles_with", "resembles"}
    assert count["in_family"] == 3  # an opening with two codes keeps two edges
    assert graph.mistakes_in_opening(edges, "ME", "Sicilian Defense: Najdorf").count() == 2
    assert graph.similar_positions(edges, nodes.select("id"), 1).count() >= 2
    q = spark.createDataFrame([(1, "how does Carl handle the najdorf"), (2, "my fork mistakes as black"), (3, "bob_1 games"), (4, "nothing here")], "qid int, text string")
    links = {(r.qid, r.kind, r.name) for r in graph.link(q, graph.surfaces(nodes), "Me").collect()}
    assert {(1, "player", "Carl"), (1, "opening", "Sicilian Defense: Najdorf"), (2, "player", "Me"), (2, "theme", "fork"), (2, "color", "black")} <= links
    assert not [x for x in links if x[0] in (3, 4)]
    docs = graph.documents(moves, games, positions, themes)
    assert docs.count() == 4 and docs.where("doc_id = 'g1:9'").first().text.startswith("fork, hanging piece. Sicilian Defense: Najdorf. Sicilian Defense. white blunder at move 5, endgame phase.")
    hits = graph.search(q, nodes, edges, docs, 10, "Me").collect()
    assert {(r.qid, r.doc_id) for r in hits} == {(2, "g2:10"), (1, "g3:2")} or {(2, "g2:10")} <= {(r.qid, r.doc_id) for r in hits}
    assert not [r for r in hits if r.qid in (3, 4)]
    assert graph.search(q, nodes, edges, docs, 10, "Me", with_similar=True).count() >= len(hits)


def test_independent_paths_earn_a_bonus(spark):
    p = spark.createDataFrame([(1, "x", "opening", 1.0), (1, "x", "family", 0.6), (1, "x", "player", 1.5), (1, "y", "opening", 1.0), (1, "y", "family", 0.6)], "qid int, position string, path string, score double")
    assert {r.position: round(r.score, 6) for r in graph.combine(p).collect()} == {"x": 6.1, "y": 1.6}


def test_report(spark, corpus):
    games, moves, positions, themes = corpus
    p = report.profile(games, moves, "Me").first()
    assert (p.games, p.score, p.moves, p.blunders) == (3, 0.5, 3, 1)
    assert [r.theme for r in report.weaknesses(games, moves, themes, "Me").collect()] == ["fork", "hanging_piece"]
    assert report.worst_examples(games, moves, themes, "Me").where("theme = 'fork'").count() == 2
    assert [r.cp_loss for r in report.training_positions(games, moves, "Me").collect()] == [300, 200]
    assert report.player_games(games, "Carl", color="white", opening="FRENCH").count() == 1
    assert report.repertoire(games, "Me").count() == 3
    said = report.claims(games, moves, themes, "Me")
    said = said.cache()
    g = report.grounding(said, games, moves, themes, "Me").first()
    assert (g.claims, g.with_citations, g.citations, g.resolved, g.supported) == (5, 5, 8, 8, 8)
    assert g.numeric_checks == g.numeric_passed == 7 and not report.grounding_issues(said, games, moves, themes, "Me").count()
    wrong = said.withColumn("n", F.when(F.col("subject_key") == "fork", 9).otherwise(F.col("n"))).withColumn("value", F.when(F.col("section") == "weakness", F.col("value") + 5).otherwise(F.col("value")))
    wrong = wrong.withColumn("citations", F.when(F.col("subject_key") == "hanging_piece", F.transform("citations", lambda c: c.withField("san", F.lit("Qh5")))).otherwise(F.col("citations")))
    found = {(r.subject_key, r.problem, r.detail) for r in report.grounding_issues(wrong, games, moves, themes, "Me").collect()}
    assert found == {("fork", "numeric mismatch", "count"), ("fork", "numeric mismatch", "mean"), ("hanging_piece", "numeric mismatch", "mean"), ("hanging_piece", "citation does not resolve", "g1:9")}
    assert report.render_markdown(said, "Me").count("- ") == 5
    told = report.to_dict(report.generate(games, moves, themes, "Me"))
    assert len(told["claims"]) == 5 and told["profile"][0]["games"] == 3 and len(told["training"]) == 2
    only = games.where("game_id = 'g1'").select("game_id")
    assert report.generate(games, moves, themes, "Me", only)["profile"].first().games == 1
    parts = report.opponent_report(games, moves, themes, "Carl")
    assert parts["header"].first().games == 2 and parts["mistakes"].count() == 1


def test_claims_of_rare_openings_are_checked(spark):
    # four games of mean loss 50 and twelve openings of one game each at 400
    rows = [(f"a{k}", "Slow", 50) for k in range(4)] + [(f"b{k}", f"Once {k}", 400) for k in range(12)]
    games = spark.createDataFrame([(g, "Me", "white", "X", o, "A00", 1.0, "2024-01-01", "u") for g, o, _ in rows], "game_id string, subject string, subject_color string, opponent string, opening string, eco string, subject_score double, date string, url string").withColumn("subject_elo", F.lit(1500))
    moves = spark.createDataFrame([(g, 11, "k", "white", True, c, 0, "ok", "Kf3") for g, _, c in rows], "game_id string, ply int, pos_key string, color string, is_subject_move boolean, cp_loss int, eval_before_cp int, judgment string, san string")
    themes = spark.createDataFrame([], "game_id string, ply int, theme string")
    said = report.claims(games, moves, themes, "Me").where("section = 'opening'")
    g = report.grounding(said, games, moves, themes, "Me").first()
    assert (g.claims, g.numeric_checks, g.numeric_passed) == (1, 1, 1)
    assert report.opening_trouble(games, moves, "Me", color="black").count() == 0


def test_similar_games_and_positions(spark, corpus):
    games, moves, positions, themes = corpus
    nodes, edges = graph.build(games, moves, positions, themes)
    docs = graph.documents(moves, games, positions, themes)
    asked = spark.createDataFrame([(1, "my fork mistakes as black"), (2, "zzz")], "qid int, text string")
    found = report.similar_games(asked, docs, nodes, edges, "Me").collect()
    assert {r.qid for r in found} == {1} and min(found, key=lambda r: r["rank"]).doc_id == "g2:10" and "graph" in min(found, key=lambda r: r["rank"]).sources
    k1 = moves.where("ply = 9").first().pos_key
    near = report.similar_positions(edges, moves, fen=k1 + " 0 40").collect()
    assert near and [r.pos_key for r in near] == [r.pos_key for r in report.similar_positions(edges, moves, k1).collect()]
    family = positions.select("pos_key", F.lit("one").alias("family"))
    assert report.similar_positions(edges, moves, k1, families=family).count() == 0


def test_query_sets(spark, tmp_path):
    rows = []
    for k in range(40):  # the subject's, white, forks in the middlegame
        rows.append((f"s{k}", "Open A" if k < 20 else "Open B", "Fam A" if k < 20 else "Fam B", "Me", "white", ["fork"], "middlegame", 250 if k < 30 else 120, True))
    for k in range(12):
        rows.append((f"o{k}", "Open C", "Fam C" if k < 7 else "Fam D", "Bob", "black", ["pin"], "opening", 300, False))
    docs = spark.createDataFrame(rows, "doc_id string, opening string, family string, player string, color string, doc_themes array<string>, phase string, cp_loss int, is_subject_move boolean")
    queries, qrels = query_sets.build_query_set(docs, "ME")
    got = {r.qid: (r.family, r.text, r.n_relevant) for r in queries.collect()}
    assert {k: v[0] for k, v in got.items()} == {"lex0": "lexical", "lex1": "lexical", "lex2": "lexical", "them0": "thematic", "para0": "paraphrase", "rel0": "relational", "relself_white_middlegame": "relational"}
    assert got["lex0"][1:] == ("blunders and mistakes in the Open A", 20) and got["them0"][1:] == ("my serious fork mistakes as white", 30)
    assert "fork" not in got["para0"][1] and got["rel0"][2] == 7 and "Bob" in got["rel0"][1] and got["relself_white_middlegame"][2] == 40
    sizes = {r.qid: r.n for r in qrels.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert sizes == {k: v[2] for k, v in got.items()}
    stats = {r.family: r for r in query_sets.query_set_stats(queries).collect()}
    assert (stats["all"].total, stats["all"].min_relevant, stats["all"].max_relevant, stats["all"].median_relevant) == (7, 7, 40, 20)
    assert query_sets.build_query_set(docs.limit(0), "Me")[0].count() == 0
    hits = qrels.where("qid <> 'rel0'").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).where("rank <= 20")
    m = {r.family: r for r in query_sets.compare(queries, qrels, {"x": hits}).collect()}
    assert m["all"].n == 7 and m["all"].empty == 1 and m["lexical"].recall_20 == (1 + 1 + 1) / 3 and m["relational"].mrr == 0.5
    query_sets.save_results(str(tmp_path), queries, query_sets.compare(queries, qrels, {"x": hits}), {"x": hits})
    told = {r.qid: r.docs for r in spark.read.json(f"{tmp_path}/per_query").collect()}
    assert told["rel0"] is None and len(told["lex0"]) == 20 and told["lex2"] == sorted(told["lex2"]) and len(told) == spark.read.json(f"{tmp_path}/queries").count() == 7
    assert {r.retriever for r in spark.read.json(f"{tmp_path}/results").collect()} == {"x"}
    # the same rows whatever the partitions
    assert relational.sampled(docs, "doc_id", 5).collect() == relational.sampled(docs.repartition(7), "doc_id", 5).collect()


def test_persistence_and_recommendations(spark):
    rows = [("a", f"g{k}", 100.0 * (1 + k % 2), k < 6) for k in range(10)] + [("b", f"h{k}", 50.0, k < 6) for k in range(10)] + [("c", f"i{k}", 10.0, k < 6) for k in range(10)] + [("d", "j", 900.0, True)]
    df = spark.createDataFrame(rows, "label string, unit string, value double, train boolean")
    one = evaluation.value_persistence(df, "label", "unit", "value", F.col("train")).first()
    assert (one.n_shared, round(one.rho, 6)) == (3, 1.0)
    assert evaluation.value_persistence(df.where("label = 'a'"), "label", "unit", "value", F.col("train")).first().rho is None
    r = evaluation.rate_persistence(df, [], "label", "value", F.col("train"), 3).first()
    assert (r.n_labels, r.n_train, r.n_test) == (4, 19, 12) and r.overlap == 2 / 3
    p = evaluation.prediction(df.withColumn("g", F.lit(1)), ["g"], "label", F.col("train")).first()
    assert (p.n_test, p.top1, p.top3, p.coverage) == (12, 4 / 12, 1.0, 1.0)
    deep = spark.createDataFrame([("p", "a", 1, 100, None), ("p", "b", 2, 40, None), ("q", "a", 1, None, 3), ("q", "c", 3, -50, None), ("r", "a", 1, 5, None)], "pos_key string, uci string, rank int, score_cp int, mate int")
    chosen = spark.createDataFrame([("p", "b"), ("q", "c"), ("r", "a"), ("s", "a")], "pos_key string, best_uci string")
    x = evaluation.recommendations(chosen, deep).first()
    assert (x.n, x.agree_1, x.agree_2, x.mean_cost, x.median_cost, x.max_cost, x.over_100) == (3, 1 / 3, 2 / 3, (60 + 1050 + 0) / 3, 60, 1050, 1)
    assert evaluation.recommendations(chosen.limit(0), deep).first().n == 0


def test_temporal_split_is_the_window(spark):
    rows = [(g, d if d % 5 else None, k) for k, (g, d) in enumerate((g, d) for g in ("a", None, "c") for d in [1, 1, 2, 2, 2, 2, 3, 7, 7, 10, 10, 4] * (1 if g else 3))] + [("z", 1, 99)]
    df = spark.createDataFrame(rows, "g string, d int, k int")
    for share in (0.25, 0.6, 0.01):
        got = {r.k: r.split for r in evaluation.temporal_split(df, ["g"], ["d", "k"], share).collect()}
        want = {}
        for g in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            cut = len(mine) - max(1, int(len(mine) * share))
            want |= {r[2]: "test" if i >= cut else "train" for i, r in enumerate(mine)}
        assert got == want


def test_full_blocks_are_dealt_out(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id", "id % 2 as block", "id * 37 % 64 as bits")
    sim = similarity.jaccard(F.col("a.bits"), F.col("b.bits"))
    got = [similarity.blocked_pairs(rows, "id", "block", sim, sim, 0.3).select("node", "other", "weight").orderBy("node", "other").collect() for size in (2048, 7) if not monkeypatch.setattr(similarity, "BLOCK", size)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_chain(spark, tmp_path, capsys):
    from tempolake import __main__ as cli
    from tempolake.plans import chain
    from tempolake.sources import pgn
    from tempolake.sources.store import Store
    from tests.test_chess import PGN

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pgn").write_text(PGN)
    store = Store(spark, f"file://{tmp_path}/s")
    texts = pgn.read_games(spark, str(tmp_path / "in"))
    assert chain.ingest(store, texts, "Ann") == {"games": 1, "moves": 9, "positions": 9}
    todo = chain.work_list(store).collect()
    assert len(todo) == 9
    keys = [r.pos_key for r in store.read("moves").orderBy("ply").collect()] + [store.read("moves").orderBy(F.desc("ply")).first().pos_key_after]
    evals = spark.createDataFrame([(k, 12, 2, 250 if i % 2 else 20, None, "g1f3" if i == 0 else "a2a3", "", False) for i, k in enumerate(keys)], "pos_key string, depth int, multipv int, score_cp int, mate int, best_uci string, pv string, failed boolean")
    for _ in range(2):
        n = chain.ingest(store, texts, "Ann", evals)
        assert (n["games"], n["moves"], n["positions"]) == (1, 9, 9)
    assert chain.work_list(store).count() == 0
    moves = store.read("moves")
    assert moves.where("ply = 1").first().best_move_san == "Nf3" and moves.where("cp_loss is not null").count() == 9
    nodes, edges, docs = chain.knowledge(store, least_seen=1)
    assert nodes.count() and edges.count() and docs.count() >= 1
    graph.save(nodes, edges, str(tmp_path / "g"))
    again = graph.load(spark, str(tmp_path / "g"))
    assert again[1].schema.names == edges.schema.names and [a.exceptAll(b).count() for a, b in zip(again, (nodes, edges), strict=True)] == [0, 0]
    asked = spark.createDataFrame([(moves.where("ply = 1").first().fen_before,), ("8/8/8/8/8/8/8/K1k5 b - - 0 1",)], "fen string")
    deep = evals.where(F.col("pos_key") == keys[0]).withColumns({"depth": F.lit(20), "score_cp": F.lit(35)})
    said = {r.side_to_move: r for r in report.analyze_position(evals.union(deep).union(deep.withColumns({"depth": F.lit(21), "failed": F.lit(True)})), asked, 30).collect()}
    assert (said["white"].eval_cp, said["white"].depth, said["white"].best_san) == (35, 20, "Nf3") and 0.5 < said["white"].win_probability < 0.6
    assert said["black"].eval_cp is None and said["black"].win_probability is None and said["black"].depth is None
    assert report.analyze_position(evals.union(deep), asked.limit(1)).first().depth == 12
    assert report.to_dict(chain.prepare_report(store, "Ann"))["profile"][0]["games"] == 1
    assert loss.annotate(moves.select("game_id", "ply", "uci", "pos_key", "pos_key_after", "terminal", "fen_before"), evals, 3).where("judgment is not null").count() == 3
    run = lambda *x: (cli.main([f"file://{tmp_path}/s", *x], spark), capsys.readouterr().out)[1]
    assert run("report", "Ann").startswith("# Preparation: Ann") and json.loads(run("report", "Ann", "--json"))["profile"][0]["games"] == 1
    assert len(run("themes").splitlines()) == store.read("move_themes").select("theme").distinct().count()
    run("worklist", str(tmp_path / "w"), "--depth", "9")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 9
    evals.write.parquet(str(tmp_path / "e"))
    assert json.loads(run("ingest", str(tmp_path / "in"), "--subject", "Ann", "--evals", str(tmp_path / "e")))["moves"] == 9
    # a version that a lost write left behind is no obstacle
    (tmp_path / "s/games/v9").mkdir()
    for v in (3, 4):
        (tmp_path / f"s/games/v{v}").mkdir(exist_ok=True)
    assert store.put("games", store.read("games")).count() == 1
    assert store.stats().first().moves == 9


def test_streams(spark, tmp_path):
    from tests.test_chess import PGN
    from tempolake.sources.store import Store

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pgn").write_text(PGN)
    store = Store(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        ingest.load(ingest.landed_games(spark, str(tmp_path / "in")), store, "Ann", str(tmp_path / "c")).awaitTermination()
    assert store.read("games").count() == 1 and store.read("moves").count() == 9
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = ingest.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("rates").agg(F.sum("n")).first()[0] <= events.count()


def test_dense_topk_holds_tiles_only():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((6000, 16)), rng.standard_normal((1500, 16))
    q /= np.sqrt((q * q).sum(1))[:, None]
    x[3000:3100] = x[:100]  # ties across batches
    own = rng.permutation(6000)
    batches = [pa.record_batch([pa.array(own[at : at + 3000]), pa.array(list(x[at : at + 3000]))], names=["d", "v"]) for at in (0, 3000)]
    tracemalloc.start()
    out = list(retrieval._best_of(batches, np.arange(1500), q, None, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # all scores of a batch are 36 MB, and the merge had several such tables at once
    s = np.round(q @ (x / np.sqrt((x * x).sum(1))[:, None]).T, 6)
    want = [list(own[np.lexsort((own, -row))[:5]]) for row in s]
    assert [list(out[0].column(1).to_numpy()[at : at + 5]) for at in range(0, 7500, 5)] == want
    with pytest.raises(ValueError):
        list(retrieval._best_of(batches, np.arange(1500), q[:, :8], None, 5))


def test_class_metrics_are_those_of_all_pairs(spark):
    docs = spark.createDataFrame([(d, d % 3 if d % 7 else None) for d in range(40)], "doc_id long, label int")
    q = spark.createDataFrame([(1, 0), (2, 1), (3, 9), (4, None)], "qid long, qlabel int")
    hits = spark.createDataFrame([(i, (i * 5 + r * 3) % 40, r) for i in (1, 2, 3) for r in range(1, 13)], "qid long, doc_id long, rank int")
    qrels = q.join(docs, F.col("label") == F.col("qlabel")).select("qid", "doc_id")
    got = evaluation.class_metrics(q, hits, docs, "qlabel", "label", 10)
    told = lambda df: sorted(tuple(None if x is None else round(x, 9) for x in r) for r in df.collect())
    assert told(got) == told(evaluation.ir_metrics(q, hits, qrels, 10))
    assert "qlabel" not in got.columns and got.where("qid = 1").first().n_relevant == 12


def test_best_rows_at_depth_50_among_copies():
    q, k = np.eye(900, 12), 50
    q[12:, 0] = 1.0
    own = np.arange(4000)[::-1].copy()
    x = np.tile(np.eye(4, 12), (1000, 1))  # a thousand copies of each of four vectors, the smallest ids last
    tracemalloc.start()
    out = list(retrieval._best_of([pa.record_batch([pa.array(own), pa.array(list(x))], names=["d", "v"])], np.arange(900), q, None, k))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and out.num_rows == 900 * k
    assert out.column(1).to_numpy()[:k].tolist() == [3 + 4 * i for i in range(k)] and out.column(1).to_numpy()[-k:].tolist() == [3 + 4 * i for i in range(k)]


def test_rrf_hybrid_searches_once_a_ranking(spark, monkeypatch):
    from tempolake.plans import domain_queries

    asked, real = [], retrieval.dense_topk
    monkeypatch.setattr(retrieval, "dense_topk", lambda *a, **k: asked.append(a[2]) or real(*a, **k))
    assert "sources" in domain_queries.rrf_hybrid(spark, "/root/testdata/sf0.001").columns and asked == [30, 30]


def test_compare_by_family_in_one_pass(spark):
    docs = spark.createDataFrame([(d, "ab"[d % 2]) for d in range(30)], "doc_id long, family string")
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "qid long, family string")
    hits = spark.createDataFrame([(i, (i * 5 + r * r) % 30, r) for i in (1, 2) for r in range(1, 5)], "qid long, doc_id long, rank int")
    qrels = q.join(docs, "family").select("qid", "doc_id")
    told = lambda df: sorted(tuple(x if isinstance(x, str) else round(x, 9) for x in r) for r in df.collect())
    found = query_sets.compare(q, docs, {"x": hits}, by_family=True)
    assert told(found) == told(query_sets.compare(q, qrels, {"x": hits})) and found.where("family = 'a'").first().empty == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("LogicalRDD" in line and "rank#" in line for line in plan) == 1


def test_bm25_is_brute_force_without_shuffled_postings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["É", "K", "x-y", "  "]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(300)] + [None, "", "W1 w1,w2", "w3 " * 500_000] + ["w1 w2"] * 40  # copies tie
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    asked = {7: "w1 w1 W2 zzz", 8: "k x", 9: "zzz", 10: None, 11: "w3 w4 w5", 12: "y"}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    found = retrieval.bm25(docs, spark.createDataFrame(list(asked.items()), "qid int, text string"), 5)
    cut = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    all_tf = [Counter(cut(t)) for t in texts]
    dl, df = [sum(c.values()) for c in all_tf], Counter(w for c in all_tf for w in c)
    n, mean = len(texts), sum(dl) / len(dl)
    want = []
    for q, t in asked.items():
        scores = []
        for i, c in enumerate(all_tf):
            s = sum(times * max(1e-6, math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl[i] / mean)) for w, times in Counter(cut(t)).items())
            if round(s, 6) > 0:
                scores.append((-round(s, 6), f"d{i:03d}"))
        want += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scores)[:5])]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.schema["qid"].dataType.simpleString() == "int" and [c for c in found.columns] == ["qid", "doc_id", "score", "rank"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert retrieval.bm25(docs.limit(0), spark.createDataFrame([(1, "w1")], "qid int, text string")).count() == 0


def test_path_scores_sort_no_edges_by_their_link(spark):
    from tempolake.plans import domain_queries

    out = domain_queries.path_scores(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # edges of one link were one key of a join by sorting, and so one task
    assert not [line for line in plan.split("\n") if "SortMergeJoin [id#" in line or "SortMergeJoin [opening#" in line or "SortMergeJoin [theme#" in line]
    assert plan.count("REPARTITION_BY_NUM") >= 6


def test_bitboard_edges_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    bits = [int(x) for x in rng.integers(-(2**63), 2**63, 150)] + [0, 0, -1, -1] + [5] * 8  # copies tie
    rows = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(bits)], "id long, g int, bits long")
    sim = similarity.jaccard(F.col("a.bits"), F.col("b.bits"))
    want = similarity.top_edges(similarity.blocked_pairs(rows, "id", "g", sim, sim, 0.35), "node", "other", "weight", 3)
    monkeypatch.setattr(similarity, "BLOCK", 20)
    found = similarity.bitboard_edges(rows, "id", "g", "bits", 3, 0.35)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 100

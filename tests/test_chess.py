"""Game records: expressions, rules, PGN, themes, losses, similarity; literal cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tempolake.functions import board, chess
from tempolake.operators import loss, similarity, themes
from tempolake.sources import pgn
from tempolake.sources.store import Store, fingerprint, hit_rate, missing_evaluations

KID = "r1bqk2r/pp2ppbp/2np1np1/8/2PNP3/2N1B3/PP3PPP/R2QKB1R w KQkq - 0 1"
FENS = {
    "KID": KID,
    "KID2": "r2qk2r/pp2ppbp/2np1np1/8/2PNP3/2N1B3/PP3PPP/R2QKB1R w KQkq - 0 1",
    "KID3": "r1bq1rk1/pp2ppbp/2np1np1/8/2PNP3/2N1B3/PP3PPP/2KRQB1R w - - 0 1",
    "FRENCH": "rnbqkbnr/pp3ppp/4p3/2pp4/3P1B2/4P3/PPP2PPP/RN1QKBNR w KQkq - 0 1",
    "START": board.START,
    "KPE": "8/5k2/6p1/8/8/6P1/5K2/8 w - - 0 40",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("60+0", "bullet"), ("180+0", "blitz"), ("300+0", "blitz"), ("600+0", "rapid"), ("1800+0", "classical"), ("15+0", "ultrabullet"), ("60+3", "blitz"), ("-", None), ("garbage", None), (None, None)])
def test_speed(spark, text, want):
    assert one(spark, chess.speed(F.lit(text).cast("string"))) == want


def test_position_expressions(spark):
    f = F.col("fen")
    rows = {r.id: r for r in spark.createDataFrame(list(FENS.items()), "id string, fen string").select("id", chess.position_key(f).alias("k"), chess.phase(f).alias("p"), chess.bitboard(f, "P").alias("w"), chess.bitboard(f, "p").alias("b"), chess.material_signature(f).alias("s")).collect()}
    assert rows["FRENCH"].w == 135325440 and rows["FRENCH"].b == 63912463438970880
    assert rows["KID"].w == 335602432 and rows["KID2"].s == "QRRBBNNPPPPPPP|QRRBNNPPPPPPP"
    assert rows["START"].k.endswith("KQkq -") and rows["START"].p == "opening" and rows["KPE"].p == "endgame"
    assert one(spark, chess.bitboard(F.lit("7k/8/8/8/8/8/8/K7 w - - 0 1"), "k")) == -(1 << 63)


def test_losses(spark):
    got = [one(spark, chess.classify_loss(F.lit(x).cast("int"))) for x in (0, 49, 50, 99, 100, 299, 300, None)]
    assert got == ["ok", "ok", "inaccuracy", "inaccuracy", "mistake", "mistake", "blunder", "unknown"]
    assert one(spark, chess.clamped(F.lit(5000), F.lit(None).cast("int"))) == 1000 and one(spark, chess.clamped(F.lit(0), F.lit(0))) == -1000
    assert math.isclose(one(spark, chess.win_probability(F.lit(100))), 0.591026, abs_tol=1e-6)
    assert [one(spark, chess.opening_family(F.lit(x).cast("string"))) for x in ("A: b", "A ", "", None)] == ["A", "A", None, None]
    rows = [(2, "white", 500, "book", True), (10, "white", 100, "mistake", True), (12, "white", 200, "mistake", True), (11, "black", 900, "mistake", False)]
    m = spark.createDataFrame(rows, "ply int, color string, cp_loss int, judgment string, is_subject_move boolean")
    assert loss.average_loss(m, subject_only=True).first().acpl == 150 and loss.average_loss(m, color="black").first().acpl == 900
    assert loss.average_loss(m.limit(0)).first().acpl == 0.0


def test_annotate(spark):
    moves = spark.createDataFrame([("g", 9, "a", "p0", "p1", None), ("g", 10, "b", "p1", "p2", None), ("g", 11, "c", "p2", "p3", None), ("g", 12, "d", "p4", "p5", "checkmate"), ("g", 2, "e", "p0", "p1", None), ("g", 13, "f", "p0", "p0", None)], "game_id string, ply int, uci string, pos_key string, pos_key_after string, terminal string")
    evals = spark.createDataFrame([("p0", 20, None, "x", False), ("p1", 400, None, "b", False), ("p1", 390, None, "b", False), ("p2", -380, None, "q", False), ("p3", 0, None, "q", True), ("p4", 50, None, "z", False)], "pos_key string, score_cp int, mate int, best_uci string, failed boolean")
    got = {r.ply: (r.cp_loss, r.judgment) for r in loss.annotate(moves, evals).collect()}
    assert got == {9: (420, "blunder"), 10: (20, "best"), 11: (None, "unanalysed"), 12: (0, "ok"), 2: (420, "book"), 13: (40, "ok")}


def perft(b, depth):
    if not depth:
        return 1
    n = 0
    for m in b.legal():
        c = b.copy()
        c.push(m)
        n += perft(c, depth - 1)
    return n


@pytest.mark.parametrize("fen, counts", [(board.START, [20, 400, 8902]), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]), ("n1n5/PPPk4/8/8/8/8/4Kppp/5N1N b - - 0 1", [24, 496])])
def test_legal_moves(fen, counts):
    assert [perft(board.Board(fen), k + 1) for k in range(len(counts))] == counts


def test_board_notation():
    b = board.Board()
    for san in "e4 e5 Nf3 Nc6 Bc4 Nf6 Ng5 d5 exd5".split():
        m = b.parse_san(san)
        assert b.san(m) == san
        b.push(m)
    assert b.fen() == "r1bqkb1r/ppp2ppp/2n2n2/3Pp1N1/2B5/8/PPPP1PPP/RNBQK2R b KQkq - 0 5"
    assert board.Board("6k1/5ppp/8/8/8/8/5PPP/4R1K1 w - - 0 1").san((4, 60, "")) == "Re8#"
    assert not board.Board("4k3/8/6p1/8/8/8/4Q3/4K3 w - - 0 1").valid()


def test_theme_detectors(spark):
    liver = "r1bqkb1r/ppp2ppp/2n2n2/3Pp1N1/2B5/8/PPPP1PPP/RNBQK2R b KQkq - 0 5"
    found, _, san = themes.detect(liver, "f6d5", "g5f7 e8f7 d1f3")
    assert "fork" in found and san == "Nxf7"
    found, swing, _ = themes.detect(liver, "f6d5", "g5f7 e8f7 d1f3 f7e6", cp_loss=250)
    assert swing < 0 and "accepts_unsound_sacrifice" in found
    assert "back_rank_mate" in themes.detect("6k1/5ppp/8/8/8/8/5PPP/4R1K1 b - - 0 1", "g8h8", "e1e8")[0]
    assert themes.line_motif(board.Board("r1bqkbnr/pppn1ppp/8/1B2p3/4P3/8/PPPP1PPP/RNBQK1NR b KQkq - 0 1"), board.square("b5"), False) == "absolute_pin"
    assert themes.line_motif(board.Board("r1bqkbnr/1ppp1ppp/p1n5/1B2p3/4P3/2N2N2/PPPP1PPP/R1BQK2R b KQkq - 0 4"), board.square("b5"), False) == "skewer"
    assert themes.detect("rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPPQPPP/RNB1KBNR w KQkq - 0 3", "e2h5", "g7g6 h5g6 h7g6")[1] > 0
    assert themes.detect(board.START, "a2a3", "e7e5 e2e4 g8f6", "opening")[0] == ["positional_error"]
    assert themes.detect(board.START, "a2a5", "e7e5")[0] == []
    df = spark.createDataFrame([(liver, "f6d5", "g5f7 e8f7 d1f3", "middlegame", None)], "a string, b string, c string, d string, e int")
    assert "fork" in df.select(themes.detect_udf("a", "b", "c", "d", "e").alias("t")).first().t.themes


def test_similarity(spark):
    df = spark.createDataFrame([(k, f, "middlegame") for k, f in FENS.items()], "pos_key string, fen string, phase string")
    f = similarity.features(df)
    pawn, whole = similarity.score()
    a = f.where("pos_key = 'KID'").alias("a")
    got = {r.k: (round(r.p, 6), round(r.w, 6)) for r in a.crossJoin(f.alias("b")).select(F.col("b.pos_key").alias("k"), pawn.alias("p"), whole.alias("w")).collect()}
    assert got["KID"] == (1, 1) and got["KID2"] == (1, 0.972857) and got["KID3"] == (1, 0.904706)
    assert got["FRENCH"] == (0.431818, 0.388636) and got["START"] == (0.5, 0.45)
    edges = {(r.lo, r.hi) for r in similarity.similarity_edges(f).collect()}
    assert ("KID", "KID2") in edges and not any("FRENCH" in e for e in edges)
    many = spark.createDataFrame([(f"{k}{i}", FENS[k], "middlegame") for k in ("KID", "KPE") for i in range(30)], "pos_key string, fen string, phase string")
    stats = similarity.blocking_stats(similarity.features(many), F.col("block")).first()
    assert (stats.blocks, stats.naive, stats.blocked) == (2, 1770, 870)


PGN = """[Event "Rated"]
[Site "https://x.org/abc123"]
[UTCDate "2024.01.02"]
[White "Ann"]
[Black "bob_1"]
[Result "1-0"]
[WhiteElo "1500"]
[BlackElo "?"]
[TimeControl "180+2"]
[Opening "Italian Game: Two Knights"]
[ECO "C57"]

1. e4 { [%eval 0.3] [%clk 0:03:00] } e5 { [%clk 0:02:59] } 2. Nf3 (2. d4 exd4) Nc6 3. Bc4 $1 Nf6 4. Ng5 d5 5. exd5 { [%eval #-3] } 1-0

[Event "Other"]
[Site "https://x.org/none"]
[Result "*"]

*

[Event "Third"]
[GameId "g3"]
[Variant "Atomic"]
[Result "0-1"]

1. e4 e5 0-1
"""


def test_pgn(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(PGN)
    games, moves = pgn.parse(pgn.read_games(spark, str(tmp_path)))
    assert [g.game_id for g in games.collect()] == ["abc123"]
    g = pgn.for_subject(games, "ANN").first()
    assert (g.date, g.subject, g.subject_color, g.subject_score, g.speed, g.white_elo, g.black_elo, g.ply_count) == ("2024-01-02", "Ann", "white", 1.0, "blitz", 1500, None, 9)
    rows = pgn.with_subject(moves, pgn.for_subject(games, "Ann")).orderBy("ply").collect()
    assert [r.san for r in rows] == "e4 e5 Nf3 Nc6 Bc4 Nf6 Ng5 d5 exd5".split()
    assert rows[0].clock_seconds == 180 and rows[0].lichess_eval == 0.3 and rows[8].lichess_eval == -100 and rows[1].move_number == 1 and rows[2].move_number == 2
    seen = pgn.positions(pgn.with_subject(moves, pgn.for_subject(games, "Ann")), games)
    assert seen.count() == 9 and seen.where("fen like 'rnbqkbnr/pppppppp%'").first().seen_count == 1


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame(list(x), "game_id string, url string")
    assert store.read("games") is None
    store.put("games", rows(("a", "1"), ("b", "1")))
    store.put("games", rows(("b", "2"), ("c", "2"), ("c", "2")))
    assert sorted(map(tuple, store.read("games").collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    seen = lambda *x: spark.createDataFrame(list(x), "pos_key string, fen string, ply int, opening string, seen_count long")
    store.add_positions(seen(("p", "f", 3, "A", 2), ("q", "g", 1, None, 1), ("q", "g", 0, "C", 1)))
    store.add_positions(seen(("p", "h", 1, "B", 5), ("r", "i", 2, "D", None)))
    assert sorted(map(tuple, store.read("positions").collect())) == [("p", "f", 3, "A", 7), ("q", "g", 0, "C", 2), ("r", "i", 2, "D", 0)]
    cache = spark.createDataFrame([("p", 12, 2)], "pos_key string, depth int, multipv int")
    pos = spark.createDataFrame([("p", "f"), ("q", "g")], "pos_key string, fen string")
    assert [r.pos_key for r in missing_evaluations(pos, cache, 12, 2).collect()] == ["q"]
    assert hit_rate(pos.select("pos_key", F.lit(12).alias("depth"), F.lit(2).alias("multipv")), cache).first().rate == 0.5
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert fingerprint(docs, "m").first().key == fingerprint(docs.orderBy(F.desc("doc_id")), "m").first().key != fingerprint(docs, "n").first().key

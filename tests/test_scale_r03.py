"""What the reading, rendering and storing of games costs: expressions that are
evaluated once, and files that are packed; with the same rows as before."""

import os

from pyspark.sql import functions as F

from rookery.operators.pgn_render import render_games
from rookery.plans import queries_evals
from rookery.sources import corpus, files, pgn

ODD_GAME = ('﻿[Event "A \\"b\\" c"]\r\n[White "W\\\\x"]\r\r\n[Black "B"]\r\n\r\n'
            '1. e4! {[%clk 0:03:02] 1. x} e5?! { 12.5 [%clk 1:05] } 2. Nf3$1 a1=Q 12...Nc6 2.0 *\r\n')


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_parts_of_a_clock_are_found_once(spark):
    df = spark.createDataFrame([("[%clk 1:02:03]", 3723), ("[%clk 2:03.9]", 123), ("[%clk 7]", None), ("x", None)], "c string, want int")
    got = df.select(pgn.clock_seconds(F.col("c")).alias("s"), "want")
    assert _plan(got).count("split(") == 1
    assert all(r.s == r.want for r in got.collect())


def test_odd_line_ends_escapes_and_numbers(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "odd.pgn")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(ODD_GAME + '\n[Event "plain"]\n\n*\n')
    one, two = pgn.parse_games(pgn.scan_pgn(spark, path, glob=None)).orderBy("game_id").collect()
    assert (one.event, one.white, one.black) == ('A "b" c', "W\\x", "B")
    assert (one.moves_uci, one.clock_times, one.num_moves) == ("e4 e5 Nf3 a1=Q Nc6 2.0", "182 65", 6)
    assert (two.event, two.num_moves, two.clock_times) == ("plain", 0, "")


def test_scan_looks_for_one_sign_of_a_game(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "some.pgn")
    with open(path, "w", encoding="utf-8") as f:
        f.write('﻿ \n\n[Event "a"]\n\n1. e4 *\n')
    raw = pgn.scan_pgn(spark, path, glob=None)
    assert raw.count() == 1
    assert "regexp_replace(left(" not in _plan(raw)


def test_moves_are_split_once_to_be_rendered(spark):
    rows = [(1, "e2e4 e7e5 g1f3", "182 65"), (2, "e2e4", "10 20 30"), (3, "", "10"), (4, "e2e4 e7e5", None), (5, None, "1")]
    games = spark.createDataFrame(rows, "game_id int, moves_uci string, clock_times string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("event", "site", "date", "white", "black", "eco", "opening", "time_control", "termination")],
        F.lit("*").alias("result"), *[F.lit(0).alias(c) for c in ("white_elo", "black_elo", "white_rd", "black_rd")])
    df = render_games(games)
    assert _plan(df).count("split(") == 2
    bodies = {r.game_id: r.pgn.split("\n\n")[1].strip() for r in df.collect()}
    assert bodies == {1: "1. e2e4 { [%clk 0:03:02] } 1... e7e5 { [%clk 0:01:05] } 2. g1f3 *", 2: "1. e2e4 { [%clk 0:00:10] } *",
                      3: "*", 4: "1. e2e4 e7e5 *", 5: "*"}


def _orders(spark, folder):
    spark.range(900).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 37).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"), F.timestamp_seconds(F.col("id") * 86400).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")


def test_a_packed_corpus_holds_the_same_games(spark, tmpdir_path, monkeypatch):
    _orders(spark, tmpdir_path)
    monkeypatch.setattr(corpus, "PACKED_GAMES", 50)
    plain, packed = corpus.games_corpus(spark, tmpdir_path), corpus.games_corpus(spark, tmpdir_path, packed=True)
    names = [n for _, _, some in os.walk(packed) for n in some if n.startswith("part-")]
    assert len(names) >= 18 and all(n.endswith(".gz") for n in names)
    of = lambda p: sorted(map(tuple, files.conform(pgn.parse_games(pgn.scan_pgn(spark, p, glob=None)), ("source", "src_game_id")).collect()))
    assert len(of(packed)) == 900 and of(packed) == of(plain)


def test_evaluation_documents_are_stored_packed(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "docs")
    monkeypatch.setattr(queries_evals, "fresh_path", lambda *_: path)
    plies = spark.createDataFrame([(1, 0, 20, None, "e2e4", "e2e4", "e4", "e4", "f1"), (1, 1, -300, None, "e7e5", "c7c5", "e5", "c5", "f2")],
                                  "game_id int, ply int, cp int, mate int, uci string, best_uci string, san string, best_san string, fen string")
    games = spark.createDataFrame([(1, "A", "B")], "game_id int, white string, black string")
    rows = queries_evals._evaluation_rows(games, plies).orderBy("ply").collect()
    assert [(r.ply, r.player, r.fen_after, r.n_best) for r in rows] == [(0, "A", "f1", 2), (1, "B", "f2", 2)]
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)

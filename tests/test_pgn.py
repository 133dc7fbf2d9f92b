"""PGN ingest on own fixture files: tags, defaults, clocks, movetext, side lines of
any depth, line ends, bad bytes, game numbering across splits, evals."""

import os

import pytest

from pyspark.sql import functions as F

from rookery.sources import files, pgn

FIX = os.path.join(os.path.dirname(__file__), "fixtures")
GAMES5 = os.path.join(FIX, "games5.pgn")


@pytest.fixture(scope="module")
def games5(spark):
    rows = pgn.parse_games(pgn.scan_pgn(spark, GAMES5, glob=None)).orderBy("game_id").collect()
    return [r.asDict() for r in rows]


def test_numbering_and_tags(games5):
    assert [g["game_id"] for g in games5] == [1, 2, 3, 4, 5]
    g1 = games5[0]
    assert g1["source"] == "games5"
    assert g1["date"] == "2025.03.02"              # UTCDate wins over Date
    assert g1["opening"] == 'Spanish "Main" Line'  # PGN escapes undone
    assert (g1["white_elo"], g1["black_elo"], g1["white_rd"], g1["black_rd"]) == (2610, 2590, 5.0, -5.0)
    assert games5[3]["date"] == "????.??.??"
    g5 = games5[4]
    assert g5["black_elo"] == 0                    # out of SMALLINT range -> 0
    assert (g5["eco"], g5["time_control"], g5["opening"]) == ("", "", "")


def test_movetext(games5):
    # side lines, NAGs, '!?' suffixes, comments and a ';' comment are skipped
    assert games5[1]["moves_uci"].split()[:4] == ["d4", "d5", "c4", "e6"]
    assert games5[3]["moves_uci"] == "e4 e5 Bc4 Nc6 Qh5 Nf6 Qxf7#"
    assert [g["num_moves"] for g in games5[1:]] == [14, 10, 7, 11]


def test_clocks(games5):
    expected = [180, 179, 178] + list(range(175, 162, -1))
    assert games5[0]["clock_times"].split()[:len(expected)] == list(map(str, expected))
    assert games5[1]["clock_times"] == ""


def _variants():
    with open(GAMES5, encoding="utf-8") as f:
        text = f.read()
    return {"lf": text, "crlf": text.replace("\n", "\r\n"), "cr_mixed": text.replace("\n\n", "\r\n\r\n"),
            "no_blank": __import__("re").sub(r"\n\n+\[Event ", "\n[Event ", text), "bom": "\ufeff\n\n" + text}


def _rows(spark, path):
    rows = pgn.parse_games(pgn.scan_pgn(spark, path, glob=None)).drop("source").orderBy("game_id").collect()
    return [r.asDict() for r in rows]


@pytest.mark.parametrize("layout", list(_variants()))
def test_line_ends_and_separators(spark, games5, tmpdir_path, layout):
    path = os.path.join(tmpdir_path, "x.pgn")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(_variants()[layout])
    assert _rows(spark, path) == [{k: v for k, v in g.items() if k != "source"} for g in games5]


def test_mixed_folder(spark, tmpdir_path):
    for name, text in _variants().items():
        with open(os.path.join(tmpdir_path, f"{name}.pgn"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    out = os.path.join(tmpdir_path, "out")
    status = files.convert_folder(spark, tmpdir_path, out).collect()
    assert {r.source: r.status for r in status} == dict.fromkeys(_variants(), "converted")
    counts = {r.source: (r.n, r.last) for r in files.read_games(spark, out, "all_games").groupBy("source").agg(
        F.count("*").alias("n"), F.max("game_id").alias("last")).collect()}
    assert counts == dict.fromkeys(_variants(), (5, 5))
    assert spark.sql("SELECT count(*) FROM all_games").first()[0] == 25


@pytest.mark.parametrize("depth", [1, 2, 8, 40])
def test_side_lines_of_any_depth(spark, tmpdir_path, depth):
    side = "(1. d4 {a (small) note} " * depth + "1... d5" + ")" * depth
    path = os.path.join(tmpdir_path, "deep.pgn")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'[Event "x"]\n[White "a"]\n\n1. e4 {side} (1. c4) e5 2. Nf3 {side} *\n')
    assert _rows(spark, path)[0]["moves_uci"] == "e4 e5 Nf3"


def test_long_side_line(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "long.pgn")
    with open(path, "w", encoding="utf-8") as f:
        f.write('[Event "x"]\n\n1. e4 (' + "Nf3 {c} Nc6 " * 20000 + ") e5 *\n")
    assert _rows(spark, path)[0]["moves_uci"] == "e4 e5"


def test_bad_bytes_are_replaced(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.pgn")
    with open(path, "wb") as f:
        f.write(b'[Event "x"]\n[White "J\xf6rg"]\n\n1. e4 {\xff} e5 *\n\n[Event "y"]\n\n1. d4 *\n')
    rows = _rows(spark, path)
    assert [r["moves_uci"] for r in rows] == ["e4 e5", "d4"] and rows[0]["white"] == "J\ufffdrg"


def test_game_with_a_start_position_keeps_its_moves(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "fen.pgn")
    with open(path, "w", encoding="utf-8") as f:
        f.write('[Event "x"]\n[FEN "8/8/8/8/8/4k3/4p3/4K3 b - - 0 1"]\n\n1... Kd3 2. Kf2 *\n')
    assert _rows(spark, path)[0]["moves_uci"] == "Kd3 Kf2"


def test_numbering_across_many_splits(spark, tmpdir_path):
    with open(GAMES5, encoding="utf-8") as f:
        text = f.read().strip() + "\n\n"
    path = os.path.join(tmpdir_path, "big.pgn")
    with open(path, "w", encoding="utf-8") as f:
        for i in range(400):
            f.write(text.replace("https://example.org/g", f"https://example.org/{i}/g"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024))
    try:
        raw = pgn.scan_pgn(spark, path, glob=None)
        assert raw.rdd.getNumPartitions() > 4
        rows = pgn.parse_games(raw).select("game_id", "site").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    ids = sorted(r.game_id for r in rows)
    assert ids == list(range(1, 2001))
    by_id = {r.game_id: r.site for r in rows}
    for gid in (1, 5, 6, 1234, 2000):
        rep, k = divmod(gid - 1, 5)
        assert by_id[gid] == f"https://example.org/{rep}/g{k + 1}"


def test_folder_scan_sources(spark, tmpdir_path):
    with open(GAMES5, encoding="utf-8") as f:
        text = f.read()
    for name in ("first.pgn", "second.PGN", "ignored.txt"):
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8") as f:
            f.write(text)
    counts = dict(pgn.scan_pgn(spark, tmpdir_path).groupBy("source").count().collect())
    assert counts == {"first": 5, "second": 5}
    ids = pgn.parse_games(pgn.scan_pgn(spark, tmpdir_path)).groupBy("source") \
        .agg({"game_id": "max"}).collect()
    assert {r[0]: r[1] for r in ids} == {"first": 5, "second": 5}


def test_evals(spark):
    raw = pgn.scan_pgn(spark, os.path.join(FIX, "annotated.pgn"), glob=None)
    rows = pgn.ply_evals(raw).orderBy("ply").collect()
    assert [(r.src_game_id, r.ply, r.cp, r.mate) for r in rows] == [
        ("77", 0, 30, None), ("77", 1, 25, None), ("77", 2, 21, None), ("77", 3, 35, None),
        ("77", 4, -10, None), ("77", 5, None, 1), ("77", 6, None, 0)]


def test_single_game_defaults(spark):
    rows = pgn.single_game_defaults(pgn.scan_pgn(spark, GAMES5, glob=None)).collect()
    g5 = [r for r in rows if r.white == "AnnaTest" and r.black == "IvanTest"][0]
    assert (g5.eco, g5.white_elo, g5.black_elo, g5.status) == ("?", "1400", "99999", "ok")


def test_no_python_and_only_the_count_at_build(spark, tmpdir_path):
    held = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    raw = pgn.scan_pgn(spark, GAMES5, glob=None)
    splits = pgn.split_table(raw)   # the one pass that runs before the parse
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pgn-build", "plan only")
    df = pgn.parse_games(raw, numbered=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert list(tracker.getJobIdsForGroup("pgn-build")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r._n for r in splits.collect()] == [5]
    df = pgn.parse_games(raw)
    plan += df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
    df.count()
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) == held

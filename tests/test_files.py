"""The games sink, the reader, and conversion batch by batch."""

import os
import time

import pytest

from pyspark.sql import functions as F

from rookery.session import fresh_path
from rookery.sources import files

ONE = '[Event "x"]\n[White "w"]\n\n1. e4 *\n'


def _put(folder, name, games, bad=False):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(ONE for _ in range(games)))


def _status(rows):
    return {r.source: r.status for r in rows.collect()}


def _times(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_batches_convert_only_what_is_new(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    _put(src, "a.pgn", 2)
    _put(src, "b.pgn", 3)
    assert _status(files.convert_folder(spark, src, out)) == {"a": "converted", "b": "converted"}
    before = _times(out)
    time.sleep(1.1)
    _put(src, "c.pgn", 1)
    _put(src, "b.pgn", 4)
    assert _status(files.convert_folder(spark, src, out)) == {"a": "skipped", "b": "converted", "c": "converted"}
    after = _times(out)
    assert {p: t for p, t in after.items() if "source=a" in p} == {p: t for p, t in before.items() if "source=a" in p}
    assert dict(files.read_games(spark, out).groupBy("source").count().collect()) == {"a": 2, "b": 4, "c": 1}
    assert _status(files.convert_folder(spark, src, out, force=True)) == dict.fromkeys("abc", "converted")


def test_a_bad_source_does_not_end_the_batch(spark, tmpdir_path, monkeypatch):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    for name in ("a", "b", "c"):
        _put(src, f"{name}.pgn", 2)
    real = files.pgn.parse_games

    def failing(raw, **kw):
        return real(raw.withColumn("text", F.when(F.col("source") == "b", F.raise_error(F.lit("bad"))).otherwise(F.col("text"))), **kw)
    monkeypatch.setattr(files.pgn, "parse_games", failing)
    rows = files.convert_folder(spark, src, out)
    assert _status(rows) == {"a": "converted", "b": "failed", "c": "converted"}
    assert {r.status: r["count"] for r in files.batch_status(rows).collect()} == {"converted": 2, "failed": 1}
    assert dict(files.read_games(spark, out).groupBy("source").count().collect()) == {"a": 2, "c": 2}


def _games(spark, ids, **extra):
    cols = [F.lit(v).alias(k) for k, v in {"event": "e", "site": "s", "date": "d", "white": "w", "black": "b", "result": "*", "white_elo": 1, "black_elo": 2,
                                           "white_rd": 0.0, "black_rd": 0.0, "eco": "", "opening": "", "time_control": "", "termination": "", "num_moves": 3,
                                           "moves_uci": "", "clock_times": "", **extra}.items()]
    return spark.createDataFrame([(i, f"s{i % 2}") for i in ids], "game_id long, source string").select("*", *cols)


def test_partitioned_write_keeps_rows_of_equal_ids(spark):
    path = fresh_path(spark, "t-games")
    games = _games(spark, [1, 2, 3])
    both = games.union(games.withColumn("source", F.lit("other")))
    files.write_games(both, path, ["source"])
    got = files.read_games(spark, path)
    assert got.count() == 6 and got.select("source", "game_id").distinct().count() == 6
    assert got.drop("source").schema.simpleString() == files.GAMES_SCHEMA.simpleString()


@pytest.mark.parametrize("extra,ids", [({"num_moves": 40000}, [1]), ({}, [1 << 31])])
def test_numbers_that_do_not_fit_fail_the_write(spark, extra, ids):
    with pytest.raises(Exception, match="does not fit"):
        files.write_games(_games(spark, ids, **extra), fresh_path(spark, "t-games"))


def test_compaction_removes_its_parts_only(spark):
    src, dst = fresh_path(spark, "t-parts"), fresh_path(spark, "t-compact")
    files.write_games(_games(spark, range(50)).repartition(5), src)
    parts = set(_times(src))
    assert len(parts) > 1
    os.makedirs(f"{src}/_temporary/0")
    open(f"{src}/_temporary/0/part-stale.parquet", "wb").write(b"half")
    files.compact_games(spark, src, dst, remove_parts=True)
    assert sorted(r.game_id for r in files.read_games(spark, dst).collect()) == list(range(50))
    assert not parts & set(_times(src)) and os.path.exists(f"{src}/_temporary/0/part-stale.parquet")


def test_append_adds_what_is_missing(spark):
    folder = fresh_path(spark, "t-append")
    one = lambda i: f'[Event "x"]\n[ParquetGameId "{i}"]\n\n1. e4 *\n'
    games = lambda ids: spark.createDataFrame([(i, one(i)) for i in ids], "game_id int, pgn string")
    for ids in ([1, 2, 2], [2, 3], [], [1, 2, 3], [4]):
        files.append_games(games(ids), folder)
    got = files.pgn.parse_games(files.pgn.scan_pgn(spark, folder, glob=None))
    assert sorted(int(r.src_game_id) for r in got.collect()) == [1, 2, 3, 4]


def test_playable_games_of_folders_and_base64(spark, tmpdir_path):
    import base64
    docs, audio = os.path.join(tmpdir_path, "docs"), os.path.join(tmpdir_path, "audio")
    os.makedirs(docs)
    os.makedirs(audio)
    payloads = {"a": b"x", "b": bytes(range(256)) * 3, "d": b"ID3"}
    for k, name in enumerate("abc"):
        path = os.path.join(docs, f"{name}.json")
        open(path, "w").write("{}")
        os.utime(path, (1000 + k, 1000 + k))
    for name, data in payloads.items():
        open(os.path.join(audio, f"{name}.mp3"), "wb").write(data)
    rows = files.playable_games(files.listing(spark, docs, "*.json"), files.listing(spark, audio, "*.mp3"), {"a": "First"}).collect()
    assert [(r.stem, r.display) for r in rows] == [("b", "b"), ("a", "First")]
    got = {os.path.basename(r.path)[:-4]: (r.length, r.b64) for r in files.file_base64(spark, audio, "*.mp3").collect()}
    assert got == {k: (len(v), base64.b64encode(v).decode()) for k, v in payloads.items()}


def test_command_line_job(spark, tmpdir_path, capsys):
    from rookery import convert_and_report
    src, games, out = (os.path.join(tmpdir_path, d) for d in ("in", "games", "report"))
    _put(src, "a.pgn", 2)
    args = ["--source", src, "--games", games, "--report", out]
    assert convert_and_report.main(args) == 0 and "1 converted" in capsys.readouterr().out
    _put(src, "b.pgn", 3)
    assert convert_and_report.main(args) == 0 and "1 converted, 1 skipped" in capsys.readouterr().out
    assert spark.read.json(f"{out}/total_games").first().total_games == 5


def test_games_that_do_not_fit_are_rejected_in_the_same_job(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    _put(src, "a [1].pgn", 3)
    _put(src, "b.pgn", 0)
    with open(os.path.join(src, "b.pgn"), "w", encoding="utf-8") as f:
        f.write("\n" + "\n\n")                      # no game at all
    long = '[Event "x"]\n[White "long"]\n\n' + "e4 " * 40000 + "*\n"
    with open(os.path.join(src, "c.pgn"), "w", encoding="utf-8") as f:
        f.write(ONE + "\n" + long + "\n" + ONE)
    with open(os.path.join(src, "d.pgn"), "w", encoding="utf-8") as f:
        f.write(long)
    rows = {r.source: r for r in files.convert_folder(spark, src, out).collect()}
    assert {k: (r.status, r.games, r.rejects) for k, r in rows.items()} == {
        "a [1]": ("converted", 3, 0), "b": ("empty", 0, 0), "c": ("converted", 2, 1), "d": ("failed", 0, 1)}
    assert rows["d"].error == "num_moves does not fit smallint: 40000"
    got = files.read_games(spark, out)
    assert sorted((r.source, r.game_id) for r in got.collect()) == [("a [1]", 1), ("a [1]", 2), ("a [1]", 3), ("c", 1), ("c", 3)]
    bad = sorted((r.source, r.number, '"white":"long"' in r.record) for r in files.read_rejects(spark, out).collect())
    assert bad == [("c", 2, True), ("d", 1, True)]
    # repaired sources lose their old rejects, a source without games its old games
    time.sleep(1.1)
    _put(src, "c.pgn", 2)
    with open(os.path.join(src, "a [1].pgn"), "w", encoding="utf-8") as f:
        f.write(long)
    assert _status(files.convert_folder(spark, src, out)) == {"a [1]": "failed", "b": "empty", "c": "converted", "d": "skipped"}
    assert sorted((r.source, r.game_id) for r in files.read_games(spark, out).collect()) == [("c", 1), ("c", 2)]
    assert sorted(r.source for r in files.read_rejects(spark, out).collect()) == ["a [1]", "d"]


def test_all_sources_are_converted_by_one_scan(spark, tmpdir_path, monkeypatch):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    for i in range(150):
        _put(src, f"s{i}.pgn", 1 + i % 3)
    scans = []
    real = files.pgn.scan_pgn
    monkeypatch.setattr(files.pgn, "scan_pgn", lambda *a, **kw: scans.append(1) or real(*a, **kw))
    rows = files.convert_folder(spark, src, out).collect()
    assert len(scans) == 1 and {r.source: r.games for r in rows} == {f"s{i}": 1 + i % 3 for i in range(150)}


def test_append_looks_through_files_that_its_table_does_not_know(spark):
    folder = fresh_path(spark, "t-append")
    one = lambda i: f'[Event "x"]\n[ParquetGameId "{i}"]\n\n1. e4 *\n'
    games = lambda ids: spark.createDataFrame([(i, one(i)) for i in ids], "game_id int, pgn string")
    os.makedirs(folder)
    with open(f"{folder}/by_hand.pgn", "w", encoding="utf-8") as f:
        f.write(one(7) + "\n" + one(8))
    assert sorted(r.game_id for r in files.append_games(games([7, 9]), folder).collect()) == [9]
    # a run that died after its text left a file that the table does not know
    games([20]).select("pgn").write.mode("append").text(folder)
    assert sorted(r.game_id for r in files.append_games(games([20, 21]), folder).collect()) == [21]
    # a known file that has changed makes the table be built anew
    time.sleep(1.1)
    with open(f"{folder}/by_hand.pgn", "w", encoding="utf-8") as f:
        f.write(one(8))
    assert sorted(r.game_id for r in files.append_games(games([7, 8, 9]), folder).collect()) == [7]
    got = files.pgn.parse_games(files.pgn.scan_pgn(spark, folder, glob=None))
    assert sorted(int(r.src_game_id) for r in got.collect()) == [7, 8, 9, 20, 21]


def test_a_conversion_without_any_game(spark, tmpdir_path):
    from rookery import convert_and_report
    src, out, report = (os.path.join(tmpdir_path, d) for d in ("in", "out", "report"))
    _put(src, "a.pgn", 1)
    with open(os.path.join(src, "a.pgn"), "w", encoding="utf-8") as f:
        f.write("\n\n")
    assert _status(files.convert_folder(spark, src, out)) == {"a": "empty"}
    with open(os.path.join(src, "b.pgn"), "w", encoding="utf-8") as f:
        f.write('[Event "x"]\n\n' + "e4 " * 40000 + "*\n")
    outcome, errors = convert_and_report.run(spark, src, out, report)
    assert _status(outcome) == {"a": "empty", "b": "failed"} and errors == {}
    assert files.read_games(spark, out).count() == 0 and spark.read.json(f"{report}/total_games").first().total_games == 0


def test_an_unreadable_file_stands_alone(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    for name in "abcde":
        _put(src, f"{name}.pgn", 2)
    with open(os.path.join(src, "broken.gz"), "wb") as f:
        f.write(b"no gzip at all")
    rows = files.convert_folder(spark, src, out, glob="*")
    assert _status(rows) == {**dict.fromkeys("abcde", "converted"), "broken": "failed"}
    assert files.read_games(spark, out).count() == 10
    assert rows.where("source = 'broken'").first().error

"""Incremental ingest: a second run adds nothing, a new file is picked up."""

import os
import shutil

from rookery.session import fresh_path
from rookery.streaming import jobs

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_ingest_stream_incremental(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    shutil.copy(os.path.join(FIX, "games5.pgn"), os.path.join(src, "first.pgn"))
    out, ck = fresh_path(spark, "t-ingest"), fresh_path(spark, "t-ingest-ck")
    jobs.ingest_stream(spark, src, out, ck)
    assert spark.read.parquet(f"{out}/games").count() == 5
    jobs.ingest_stream(spark, src, out, ck)
    assert spark.read.parquet(f"{out}/games").count() == 5
    shutil.copy(os.path.join(FIX, "games5.pgn"), os.path.join(src, "second.pgn"))
    jobs.ingest_stream(spark, src, out, ck)
    df = spark.read.parquet(f"{out}/games")
    assert df.count() == 10
    assert sorted(r.game_id for r in df.where("source = 'second'").collect()) == [1, 2, 3, 4, 5]
    assert df.where("source = 'first' AND game_id = 1").collect()[0].num_moves > 17


def test_numbers_go_on_over_batches(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in", "source=one")
    os.makedirs(src)
    out, ck = fresh_path(spark, "t-ingest"), fresh_path(spark, "t-ingest-ck")
    folder = os.path.dirname(src)
    text = open(os.path.join(FIX, "games5.pgn"), encoding="utf-8").read()
    for i, ends in enumerate(("\n", "\r\n", "\n")):
        with open(os.path.join(src, f"part{i}.pgn"), "w", encoding="utf-8", newline="") as f:
            f.write(text.replace("\n", ends))
        jobs.ingest_stream(spark, folder, out, ck, max_files_per_trigger=1)
    df = spark.read.parquet(f"{out}/games")
    assert sorted(r.game_id for r in df.collect()) == list(range(1, 16))
    assert df.where("game_id = 11").first().site == df.where("game_id = 1").first().site


def test_daily_stream_drops_late_rows(spark, tmpdir_path):
    import datetime as dt
    import time

    import pandas as pd
    src = os.path.join(tmpdir_path, "events")
    os.makedirs(src)
    day1 = dt.datetime(2024, 1, 1, 10)

    def write(name, stamps):
        pd.DataFrame({"ts": stamps}).to_parquet(os.path.join(src, name), coerce_timestamps="us")
        time.sleep(1.1)   # the file source orders new files by modification time
    # batch 0: three day-1 events and one at day 2 23:30 -> watermark day 2 22:30
    write("a.parquet", [day1, day1, day1, dt.datetime(2024, 1, 2, 23, 30)])
    # batch 1: the watermark has passed day 1, which is emitted with 3 games
    write("b.parquet", [dt.datetime(2024, 1, 2, 23, 45)])
    # batch 2: two more day-1 events, behind the watermark -> dropped
    write("c.parquet", [day1, day1])
    schema = spark.read.parquet(os.path.join(src, "a.parquet")).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = fresh_path(spark, "t-daily"), fresh_path(spark, "t-daily-ck")
    jobs.daily_activity_stream(spark, events, out, ck, delay="1 hour")
    rows = {r.day_start.date(): r["count"] for r in spark.read.parquet(out).collect()}
    assert rows == {dt.date(2024, 1, 1): 3}     # day 2 is still open


def test_a_changed_file_replaces_its_games(spark, tmpdir_path):
    import time
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    one = lambda s: f'[Event "x"]\n[Site "{s}"]\n\n1. e4 *\n\n'

    def put(name, sites):
        with open(os.path.join(src, name), "w", encoding="utf-8") as f:
            f.write("".join(map(one, sites)))

    out, ck = fresh_path(spark, "t-ingest"), fresh_path(spark, "t-ingest-ck")

    def run():
        jobs.ingest_stream(spark, src, out, ck)
        return sorted((r.source, r.game_id, r.site) for r in spark.read.parquet(f"{out}/games").collect())

    put("a.pgn", "xy")
    put("b c.pgn", "z")
    first = [("a", 1, "x"), ("a", 2, "y"), ("b c", 1, "z")]
    assert run() == first and run() == first
    time.sleep(1.1)
    put("a.pgn", "xyw")           # more games: the old keep their numbers
    put("d.pgn", "d")
    assert run() == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "w"), ("b c", 1, "z"), ("d", 1, "d")]
    time.sleep(1.1)
    put("a.pgn", "q")             # fewer
    put("b c.pgn", "")            # none at all
    open(os.path.join(src, "b c.pgn"), "w").write("\n\n")
    assert run() == [("a", 1, "q"), ("d", 1, "d")]
    time.sleep(1.1)
    put("a.pgn", "qrst")          # numbers that were given are used again, then new ones
    assert [r for r in run() if r[0] == "a"] == [("a", 1, "q"), ("a", 2, "r"), ("a", 3, "s"), ("a", 4, "t")]


def test_a_repeated_batch_gives_the_same_numbers(spark, tmpdir_path):
    """A run whose checkpoint is lost behind its output (a batch that is run again) changes nothing."""
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for name in ("first", "second"):
        shutil.copy(os.path.join(FIX, "games5.pgn"), os.path.join(src, f"{name}.pgn"))
    out, ck = fresh_path(spark, "t-ingest"), fresh_path(spark, "t-ingest-ck")
    jobs.ingest_stream(spark, src, out, ck)
    read = lambda: sorted((r.source, r.game_id, r.white) for r in spark.read.parquet(f"{out}/games").collect())
    before = read()
    os.remove(os.path.join(ck, "commits", "0"))
    crc = os.path.join(ck, "commits", ".0.crc")
    if os.path.exists(crc):
        os.remove(crc)
    jobs.ingest_stream(spark, src, out, ck)
    assert read() == before and len(before) == 10


def test_late_rows_go_to_a_side_table(spark, tmpdir_path):
    import datetime as dt
    import time

    import pandas as pd
    src = os.path.join(tmpdir_path, "events")
    os.makedirs(src)
    day1 = dt.datetime(2024, 1, 1, 10)
    parts = {"a": [(1, day1), (2, day1), (3, dt.datetime(2024, 1, 2, 23, 30)), (4, None)], "b": [(5, dt.datetime(2024, 1, 2, 23, 45)), (6, day1)],
             "c": [(7, dt.datetime(2024, 1, 2, 1)), (8, dt.datetime(2024, 1, 5))], "d": [(9, dt.datetime(2024, 1, 2, 2)), (10, dt.datetime(2024, 1, 4, 23, 30))]}
    out, ck = fresh_path(spark, "t-activity"), fresh_path(spark, "t-activity-ck")
    for name, rows in parts.items():
        pd.DataFrame(rows, columns=["id", "ts"]).to_parquet(os.path.join(src, f"{name}.parquet"), coerce_timestamps="us")
        time.sleep(1.1)
        schema = spark.read.parquet(os.path.join(src, "a.parquet")).schema
        jobs.activity_stream(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), out, ck, delay="1 hour")
    days = {r.day_start.date(): r["count"] for r in spark.read.parquet(f"{out}/days").collect()}
    assert days == {dt.date(2024, 1, 1): 2, dt.date(2024, 1, 2): 3}
    assert sorted(r.id for r in spark.read.parquet(f"{out}/late").collect()) == [6, 9]
    assert len([d for d in os.listdir(f"{out}/state") if d.startswith("batch=")]) == 2


def test_current_results_read_one_snapshot(spark, tmpdir_path):
    import time
    src = os.path.join(tmpdir_path, "games")
    out, ck = fresh_path(spark, "t-results"), fresh_path(spark, "t-results-ck")
    for i in range(5):
        spark.createDataFrame([("1-0" if i % 2 else "0-1",), ("*",), (None,)], "result string").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.1)
        jobs.results_stream(spark, spark.readStream.schema("result string").parquet(src), out, ck)
    assert {r.result: r["count"] for r in jobs.current_results(spark, out).collect()} == {"1-0": 2, "0-1": 3, "*": 5, None: 5}
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 2

"""Streaming queries: each runs its stream to the end of the available input
(``availableNow``) and returns the sink's content."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pgn_render import render_games
from ..session import child_names, file_system, fresh_path
from ..sources import corpus
from ..sources import testdata as td
from ..streaming import jobs
from .catalog import register

SOURCE = r"regexp_replace(lower(event), '[^a-z0-9]+', '_', 'g')"


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, ck = fresh_path(spark, "ingest"), fresh_path(spark, "ingest-ck")
    folder = corpus.games_corpus(spark, sf_dir)
    # some files a batch, so that the sources' numbers go on over several batches
    jobs.ingest_stream(spark, folder, out, ck, glob=None, max_files_per_trigger=3)
    # a second run finds nothing new and adds no batch
    jobs.ingest_stream(spark, folder, out, ck, glob=None)
    return _game_columns(spark.read.parquet(f"{out}/games"))


def _game_columns(games: DataFrame) -> DataFrame:
    return games.select("source", F.col("game_id").cast("int"), F.col("src_game_id").cast("int"), "white", "black", "result", "date", "eco", "moves_uci")


_GAME_COLUMNS = "source, CAST(game_id AS INT) AS game_id, src_game_id, white, black, result, date, eco, moves_uci"
register("ingest_stream", _ingest, f"""
SELECT {_GAME_COLUMNS} FROM (
  SELECT * REPLACE (ROW_NUMBER() OVER (PARTITION BY event ORDER BY game_id) AS game_id), game_id AS src_game_id, {SOURCE} AS source FROM games)""", ("games",))

FILES = 4
_FILE = f"1 + game_id % {FILES + 1}"
_LATER = "game_id % 3 = 0"


def _put_files(spark: SparkSession, games: DataFrame, folder: str) -> None:
    """Games with a ``file`` column as <folder>/source=<source>/<file>.pgn, over what is there."""
    made = fresh_path(spark, "pgn-made")
    rows = render_games(games, keep=("source", "file")).repartition(4 * FILES, "source", "file").sortWithinPartitions("source", "file", "game_id")
    rows.select("source", "file", "pgn").write.partitionBy("source", "file").text(made)
    fs, root = file_system(spark, made)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for source in child_names(spark, made):
        for file in child_names(spark, f"{made}/{source}") if source.startswith("source=") else []:
            part = next(n for n in child_names(spark, f"{made}/{source}/{file}") if n.startswith("part-"))
            target = path(f"{folder}/{source}/{file.removeprefix('file=')}.pgn")
            fs.mkdirs(target.getParent())
            fs.delete(target, False)
            fs.rename(path(f"{made}/{source}/{file}/{part}"), target)


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over four files a source; then file 2 comes back with more games, file 3 with
    fewer, file 4 without any but one, and file 5 is new; a run takes what has changed."""
    folder, out, ck = fresh_path(spark, "pgn-versions"), fresh_path(spark, "ingest"), fresh_path(spark, "ingest-ck")
    games = td.games(spark, sf_dir).withColumn("source", corpus.source_name("event")).withColumn("file", F.expr(f"concat('f', cast({_FILE} as string))"))
    _put_files(spark, games.where(f"file <> 'f5' AND NOT (file = 'f2' AND {_LATER})"), folder)
    jobs.ingest_stream(spark, folder, out, ck, max_files_per_trigger=3)
    time.sleep(1.1)  # file times may be whole seconds
    _put_files(spark, games.where(f"file IN ('f2', 'f5') OR file = 'f3' AND NOT ({_LATER})"), folder)
    jobs.ingest_stream(spark, folder, out, ck)
    return _game_columns(spark.read.parquet(f"{out}/games"))


register("ingest_stream_replaced", _replaced, f"""
, f AS (SELECT *, {SOURCE} AS source, 'f' || CAST({_FILE} AS VARCHAR) AS file, {_LATER} AS later FROM games)
, v1 AS (SELECT source, file, game_id, ROW_NUMBER() OVER (PARTITION BY source, file ORDER BY game_id) AS pos FROM f
         WHERE file <> 'f5' AND NOT (file = 'f2' AND later))
, n1 AS (SELECT source, file, COUNT(*) AS had,
                COALESCE(SUM(COUNT(*)) OVER (PARTITION BY source ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                SUM(COUNT(*)) OVER (PARTITION BY source) AS last
         FROM v1 GROUP BY source, file)
, v2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, file ORDER BY game_id) AS pos FROM f WHERE NOT (file = 'f3' AND later))
, n2 AS (SELECT v2.source, v2.file, COUNT(*) AS has, any_value(n1.had) AS had, any_value(n1.before) AS before
         FROM v2 LEFT JOIN n1 ON v2.source = n1.source AND v2.file = n1.file GROUP BY ALL)
, n3 AS (SELECT *, (SELECT MAX(last) FROM n1 WHERE n1.source = n2.source)
                   + COALESCE(SUM(GREATEST(has - COALESCE(had, 0), 0)) OVER (PARTITION BY source ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind
         FROM n2)
SELECT v2.source, CAST(CASE WHEN pos <= COALESCE(had, 0) THEN before + pos ELSE behind + pos - COALESCE(had, 0) END AS INT) AS game_id,
       v2.game_id AS src_game_id, white, black, result, date, eco, moves_uci
FROM v2 JOIN n3 ON v2.source = n3.source AND v2.file = n3.file""", ("games",))

DELAY_HOURS = 1


def _in_thirds(table: DataFrame, column: str) -> list[DataFrame]:
    """The table as three parts in the order of a time column."""
    t = F.unix_timestamp(F.col(column).cast("timestamp"))
    low, high = table.agg(F.min(t), F.max(t)).first()
    third = F.least(F.floor((t - low) * 3 / max(high - low, 1)), F.lit(2))
    return [table.where(third == k) for k in range(3)]


def _daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = td.table(spark, sf_dir, "events").select("ts")
    folder, out, ck = fresh_path(spark, "events-in"), fresh_path(spark, "daily"), fresh_path(spark, "daily-ck")
    for part in _in_thirds(table, "ts"):  # the stream runs again as data arrive
        part.write.mode("append").parquet(folder)
        events = spark.readStream.schema(table.schema).parquet(folder)
        jobs.daily_activity_stream(spark, events, out, ck, delay=f"{DELAY_HOURS} hour")
    return spark.read.parquet(out).select("day_start", "count")


# Append mode emits only days that end before the final watermark.
register("daily_activity_stream", _daily_stream, f"""
SELECT date_trunc('day', ts) AS day_start, COUNT(*) AS count FROM events
GROUP BY 1
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL {DELAY_HOURS} HOUR""")

_HELD_BACK = "event_id % 10 = 3"


def _late_events(spark: SparkSession, sf_dir: str) -> str:
    """Three runs; a tenth of the first third's events arrives with the last third only."""
    table = td.table(spark, sf_dir, "events")
    folder, out, ck = fresh_path(spark, "events-in"), fresh_path(spark, "activity"), fresh_path(spark, "activity-ck")
    first, second, last = _in_thirds(table, "ts")
    for part in (first.where(f"NOT ({_HELD_BACK})"), second, last.unionByName(first.where(_HELD_BACK))):
        part.write.mode("append").parquet(folder)
        jobs.activity_stream(spark, spark.readStream.schema(table.schema).parquet(folder), out, ck, delay=f"{DELAY_HOURS} hour")
    return out


_THIRDS = f"""
WITH b AS (SELECT min(epoch(ts)::BIGINT) AS low, max(epoch(ts)::BIGINT) AS high FROM events)
, e AS (SELECT events.*, least(floor((floor(epoch(ts))::BIGINT - low) * 3 / CAST(greatest(high - low, 1) AS DOUBLE)), 2) AS third FROM events, b)
, m AS (SELECT max(ts) FILTER (third = 1 OR third = 0 AND NOT ({_HELD_BACK})) - INTERVAL {DELAY_HOURS} HOUR AS passed, max(ts) - INTERVAL {DELAY_HOURS} HOUR AS final FROM e)
, l AS (SELECT e.*, third = 0 AND {_HELD_BACK} AND date_trunc('day', ts) + INTERVAL 1 DAY <= passed AS late FROM e, m)
"""
register("late_events", lambda s, d: s.read.parquet(f"{_late_events(s, d)}/late").select("event_id", "ts", "user_id", "watermark"),
         _THIRDS + "SELECT event_id, ts, user_id, passed AS watermark FROM l, m WHERE late")
register("activity_days", lambda s, d: s.read.parquet(f"{_late_events(s, d)}/days").select("day_start", "count"),
         _THIRDS + """SELECT date_trunc('day', ts) AS day_start, COUNT(*) AS count FROM l, m WHERE NOT late
GROUP BY 1, final HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= final""")


def _results_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = td.table(spark, sf_dir, "orders")
    folder, out, ck = fresh_path(spark, "orders-in"), fresh_path(spark, "results"), fresh_path(spark, "results-ck")
    for part in _in_thirds(table, "o_orderdate"):  # every result is updated in every run
        part.write.mode("append").parquet(folder)
        orders = spark.readStream.schema(table.schema).parquet(folder)
        jobs.results_stream(spark, spark.sql(td.GAMES_SQL, orders=orders), out, ck)
    return jobs.current_results(spark, out)


register("results_stream", _results_stream,
         "SELECT result, COUNT(*) AS count FROM games GROUP BY result", ("games",))

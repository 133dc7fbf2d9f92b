"""Structured Streaming jobs.

The reference converts PGN files on demand, those that are new or newer than their
result. Here the same work runs as streams with a checkpoint that process what has
arrived and stop (``trigger(availableNow=True)``). Every batch replaces its own
output when it is run again, and keeps what the next one needs as a snapshot
(``snapshots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import unescaped
from ..session import delete_paths, escaped_name, path_exists
from ..sources import files, pgn
from .snapshots import Snapshots


def _write_batch(out: str, partition_by: list[str] | None = None):
    def sink(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out}/batch={batch_id}")
    return sink


# ---------------------------------------------------------------- I1

_VERSION = "path string, modified timestamp, source string"
#: Of every file its newest version, its games, and the numbers that it has been given.
_RANGES = "array<struct<pos: long, first: long, n: long>>"
_NUMBERS = f"path string, source string, modified timestamp, games long, ranges {_RANGES}"


def log_versions(spark: SparkSession, folder: str, log: str, glob: str | None, per_batch: int | None) -> None:
    """Append to ``log`` the versions (path, modification time) of the files of
    ``folder`` that it does not hold yet, ``per_batch`` to a file, by source and path.
    The driver holds the listing of what is new."""
    seen = files.list_files(spark, folder, glob).select("path", F.col("modificationTime").alias("modified"), "source")
    if path_exists(spark, log):
        seen = seen.join(spark.read.schema(_VERSION).parquet(log), ["path", "modified"], "left_anti").select("path", "modified", "source")
    new = seen.orderBy("source", "path").collect()
    step = per_batch or max(1, len(new))
    for at in range(0, len(new), step):  # one after the other: the stream takes log files in the order of their times
        spark.createDataFrame(new[at:at + step], _VERSION).coalesce(1).write.mode("append").parquet(log)


def _given(state: DataFrame, counted: DataFrame) -> DataFrame:
    """The numbers after a batch: a file keeps the ranges that it has, and if it has
    more games now, gets one more behind the last number of its source."""
    none = F.array().cast(_RANGES)
    had = F.aggregate(F.coalesce("ranges", none), F.lit(0).cast("long"), lambda a, r: a + r["n"])
    last = (state.select("source", F.explode("ranges").alias("r")).groupBy("source")
            .agg(F.max(F.col("r.first") + F.col("r.n") - 1).alias("last")))
    new = (counted.join(state.select("path", "ranges"), "path", "left").join(last, "source", "left")
           .withColumn("had", had).withColumn("more", F.greatest(F.col("games") - F.col("had"), F.lit(0))))
    before = Window.partitionBy("source").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce("last", F.lit(0)) + F.coalesce(F.sum("more").over(before), F.lit(0)) + 1
    own = F.array(F.struct((F.col("had") + 1).alias("pos"), first.alias("first"), F.col("more").alias("n"))).cast(_RANGES)
    ranges = F.concat(F.coalesce("ranges", none), F.when(F.col("more") > 0, own).otherwise(none))
    new = new.select("path", "source", "modified", "games", ranges.alias("ranges"))
    return state.join(new, "path", "left_anti").unionByName(new)


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str,
                  glob: str | None = pgn.DEFAULT_GLOB, max_files_per_trigger: int | None = None) -> None:
    """PGN files of ``folder`` -> games Parquet; new files, and new versions of
    files that have changed.

    A run lists the folder and logs the versions that it has not seen; the stream
    reads that log, so each version is taken once. The games of a file make up a
    partition of their own below ``<out>/games`` (source, file), which a new version
    replaces. Numbers go on within a source from batch to batch: a game has the
    number of its place in its file, a replaced file keeps the numbers it was given,
    and what it has more gets numbers behind all others. The numbers are kept as a
    snapshot with a row per file (``<out>/numbers``)."""
    log, games_out = f"{out}/files", f"{out}/games"
    log_versions(spark, folder, log, glob, max_files_per_trigger)
    if not path_exists(spark, log):
        return
    numbers = Snapshots(spark, f"{out}/numbers", _NUMBERS)

    def sink(batch: DataFrame, batch_id: int) -> None:
        versions = batch.groupBy("path").agg(F.max("modified").alias("modified"), F.max("source").alias("source")).collect()
        if not versions:
            return
        listed = spark.createDataFrame(versions, _VERSION)
        # a file that has gone since it was listed counts as empty
        raw = pgn.scan_pgn(spark, [files.literal_path(v.path) for v in versions], glob=None, base_path=folder, missing_ok=True)
        splits = pgn.split_table(raw)
        key = _read_key("file_path")
        counted = (listed.withColumn("k", _listed_key("path"))
                   .join(splits.groupBy(key.alias("k")).agg(F.sum("_n").alias("games")), "k", "left")
                   .select("path", "source", "modified", F.coalesce("games", F.lit(0)).cast("long").alias("games")))
        state = numbers.write(_given(numbers.before(batch_id), counted), batch_id)
        own = state.join(listed.select("path"), "path", "left_semi")
        in_files = splits.select("file_path").distinct().withColumn("k", key) \
            .join(own.select(_listed_key("path").alias("k"), "ranges"), "k").select("file_path", "ranges")
        games = pgn.parse_games(pgn.number_games_in_ranges(raw, splits, in_files), numbered=False, keep=("file_path",))
        (games.withColumn("file", F.lower(F.hex(key))).drop("file_path")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "file").parquet(games_out))
        empty = own.where("games = 0").select("source", F.lower(F.hex(_listed_key("path"))).alias("file")).collect()
        delete_paths(spark, [f"{games_out}/source={escaped_name(spark, e.source)}/file={e.file}" for e in empty])

    reader = spark.readStream.schema(_VERSION)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", 1)
    q = (reader.parquet(log).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"


def _listed_key(c: str) -> Column:
    """A number for a file by its path as a listing writes it."""
    return F.xxhash64(F.regexp_replace(c, _SCHEME, "/"))


def _read_key(c: str) -> Column:
    """The same number by the path that a reader's ``_metadata`` gives, which is escaped."""
    return F.xxhash64(F.regexp_replace(unescaped(c), _SCHEME, "/"))


# ---------------------------------------------------------------- I2

def _utc(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP: read a TIMESTAMP_NTZ wall clock as UTC, whatever the session time zone is."""
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        return events.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp"))
    return events


def daily_activity_stream(spark: SparkSession, events: DataFrame, out: str, checkpoint: str,
                          ts: str = "ts", delay: str = "1 hour") -> None:
    """Events per day on a stream; append mode emits a day once the
    watermark (max event time - ``delay``) has passed its end. Rows behind the
    previous micro-batch's watermark are dropped (Spark filters late rows with
    the watermark one batch behind the one that evicts state); where they matter,
    ``activity_stream`` keeps them."""
    counts = (_utc(events, ts).withWatermark(ts, delay)
              .groupBy(F.window(ts, "1 day").alias("w"))
              .agg(F.count(F.lit(1)).alias("count"))
              .select(F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "count"))
    q = (counts.writeStream.outputMode("append").foreachBatch(_write_batch(out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


#: The open days, and in one row without a day the watermark; times in microseconds.
_OPEN_DAYS = "day long, count long, watermark long"
_DAY = 86_400_000_000


def activity_stream(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, ts: str = "ts", delay: str = "1 hour") -> None:
    """I2 with a side table for late rows.

    ``<out>/days`` gets a day (day_start, day_end, count) once the watermark, the
    latest event time of all batches less ``delay``, has passed its end. A row of a
    day that an earlier batch has emitted goes to ``<out>/late`` with all its columns
    and the watermark that it missed; it is counted in no day. The state, open days
    and the watermark, is a snapshot: it does not grow with the number of batches."""
    states = Snapshots(spark, f"{out}/state", _OPEN_DAYS)
    lag = int(spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {delay})").first()[0])
    micros = F.unix_micros(ts)
    start = micros - F.pmod(micros, F.lit(_DAY))

    def sink(batch: DataFrame, batch_id: int) -> None:
        state = states.before(batch_id)
        known = state.where("day IS NULL").agg(F.max("watermark")).first()[0]
        passed = start + _DAY <= F.lit(known) if known is not None else F.lit(False)
        late = batch.where(passed).withColumn("watermark", F.timestamp_micros(F.lit(known).cast("long")))
        late.write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        counted = batch.where(~passed & F.col(ts).isNotNull()).groupBy(start.alias("day")).agg(F.count(F.lit(1)).alias("count"), F.max(micros).alias("newest"))
        merged = (state.where("day IS NOT NULL").select("day", "count", F.lit(None).cast("long").alias("newest")).unionByName(counted)
                  .groupBy("day").agg(F.sum("count").alias("count"), F.max("newest").alias("newest")))
        # one row more for the watermark, which never moves back
        mark = merged.agg(F.greatest(F.max("newest") - lag, F.lit(known).cast("long"))).first()[0]
        rows = merged.select("day", "count", F.lit(None).cast("long").alias("watermark")).unionByName(
            spark.createDataFrame([(None, None, mark)], _OPEN_DAYS))
        closed = F.col("day") + _DAY <= F.lit(mark).cast("long")
        days = merged.where(closed) if mark is not None else merged.limit(0)
        (days.select(F.timestamp_micros("day").alias("day_start"), F.timestamp_micros(F.col("day") + _DAY).alias("day_end"), "count")
         .write.mode("overwrite").parquet(f"{out}/days/batch={batch_id}"))
        states.write(rows.where(F.col("day").isNull() | ~closed) if mark is not None else rows, batch_id)

    q = (_utc(events, ts).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------- I3

def results_stream(spark: SparkSession, games: DataFrame, out: str, checkpoint: str) -> None:
    """Running game counts per result. Every micro-batch gives the counts that
    changed (update mode); they replace those of the snapshot, which holds one
    current row per result (``current_results``)."""
    counts = games.groupBy("result").agg(F.count(F.lit(1)).alias("count"))
    states = Snapshots(spark, out, _RESULTS)

    def sink(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("result", F.col("count").cast("long").alias("count"))
        old, new = states.before(batch_id), changed.select(F.col("result").alias("new"))
        states.write(old.join(new, F.col("result").eqNullSafe(F.col("new")), "left_anti").unionByName(changed), batch_id)

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


_RESULTS = "result string, count long"


def current_results(spark: SparkSession, out: str) -> DataFrame:
    """The current count of every result: the newest snapshot alone is read."""
    return Snapshots(spark, out, _RESULTS).before()

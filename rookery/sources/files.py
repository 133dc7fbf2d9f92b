"""File-level jobs: games Parquet sink and compaction, folder conversion,
freshness test, batch outcome, file listings, base64 of binary files.

Listings use the ``binaryFile`` source without its ``content`` column, so only
metadata is read; the content is read only where it is the output (A22).
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import child_names, delete_paths, escaped_name, path_exists, stored
from . import pgn

# Fixed schema of the games table.
GAMES_SCHEMA = T.StructType([
    T.StructField("game_id", T.IntegerType()), T.StructField("event", T.StringType()),
    T.StructField("site", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("white", T.StringType()), T.StructField("black", T.StringType()),
    T.StructField("result", T.StringType()), T.StructField("white_elo", T.ShortType()),
    T.StructField("black_elo", T.ShortType()), T.StructField("white_rd", T.FloatType()),
    T.StructField("black_rd", T.FloatType()), T.StructField("eco", T.StringType()),
    T.StructField("opening", T.StringType()), T.StructField("time_control", T.StringType()),
    T.StructField("termination", T.StringType()), T.StructField("num_moves", T.ShortType()),
    T.StructField("moves_uci", T.StringType()), T.StructField("clock_times", T.StringType()),
])
GAME_COLUMNS = [f.name for f in GAMES_SCHEMA.fields]


def _fits(name: str, kind: T.DataType) -> Column | None:
    """Whether a value fits the type of the fixed schema; None where any does."""
    bits = {"smallint": 15, "int": 31}.get(kind.simpleString())
    if bits is None:
        return None
    return F.col(name).isNull() | F.col(name).cast("long").between(-(1 << bits), (1 << bits) - 1)


def _misfit(name: str, kind: T.DataType) -> Column:
    return F.concat(F.lit(f"{name} does not fit {kind.simpleString()}: "), F.col(name).cast("string"))


def _narrowed(name: str, kind: T.DataType, bad: Column) -> Column:
    """A column in the type of the fixed schema, ``bad`` where it does not fit."""
    fits = _fits(name, kind)
    if fits is None:
        return F.col(name).cast(kind)
    value = F.when(fits, F.col(name)).otherwise(bad.cast("long")).cast(kind)
    return F.coalesce(value, F.lit(0).cast(kind)) if kind == T.ShortType() else value


def conform(games: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cast to the fixed schema, behind the columns named in ``keep``. Missing
    ratings and counts are 0; numbers out of range are an error."""
    return games.select(*keep, *[_narrowed(f.name, f.dataType, F.raise_error(_misfit(f.name, f.dataType))).alias(f.name) for f in GAMES_SCHEMA.fields])


def sorted_out(games: DataFrame) -> DataFrame:
    """Games in the fixed schema, or why they are none: ``source``, ``outcome``
    (games or rejects), the games' columns, and for a reject its ``number`` in the
    source, the ``reason`` and the tags and moves that it came with (``record``)."""
    reasons = [F.when(~_fits(f.name, f.dataType), _misfit(f.name, f.dataType)) for f in GAMES_SCHEMA.fields if _fits(f.name, f.dataType) is not None]
    df = games.withColumn("reason", F.nullif(F.concat_ws("; ", *reasons), F.lit("")))
    bad = F.col("reason").isNotNull()
    record = F.to_json(F.struct(*[c for c in games.columns if c not in ("source", "game_id")]))
    null = F.lit(None).cast("long")
    return df.select("source", F.when(bad, F.lit("rejects")).otherwise(F.lit("games")).alias("outcome"),
                     *[F.when(~bad, _narrowed(f.name, f.dataType, null)).alias(f.name) for f in GAMES_SCHEMA.fields],
                     F.when(bad, F.col("game_id")).alias("number"), "reason", F.when(bad, record).alias("record"))


def write_games(games: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Games with the fixed schema, snappy Parquet. ``partition_by`` names
    further columns of ``games``, which become folders."""
    extra = tuple(c for c in partition_by or () if c not in GAME_COLUMNS)
    w = conform(games, extra).write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_games(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A games table, partitioned by source or not, or the games of a
    conversion, and on request a SQL view of it. The schema is given, so no file
    is opened before it is read."""
    names = child_names(spark, path)
    by_source = T.StructType([*GAMES_SCHEMA.fields, T.StructField("source", T.StringType())])
    if "outcome=games" in names:
        df = spark.read.schema(by_source).parquet(f"{path}/outcome=games")
    elif any(name.startswith("outcome=") for name in names):  # a conversion that kept no game
        df = spark.createDataFrame([], by_source)
    else:
        df = spark.read.schema(by_source if any(name.startswith("source=") for name in names) else GAMES_SCHEMA).parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What a conversion could not keep: (source, number, reason, record)."""
    schema = "number long, reason string, record string, outcome string, source string"
    return spark.read.schema(schema).parquet(path).where("outcome = 'rejects'").select("source", "number", "reason", "record")


def compact_games(spark: SparkSession, src: str, dst: str, files: int | None = None,
                  remove_parts: bool = False) -> None:
    """Merge part files into range-ordered files by game id (no single-file
    funnel: each output file is a contiguous id range, sorted). The number of
    files follows the data unless ``files`` is given. Only the parts listed when
    the job starts are read; with ``remove_parts`` exactly those are deleted once
    the result is complete, so parts that arrive meanwhile, and parts of an
    unfinished write, are left alone."""
    parts = [r.path for r in list_files(spark, src, "*.parquet").select("path").distinct().collect()]
    df = spark.read.schema(GAMES_SCHEMA).parquet(*parts)
    df = df.repartitionByRange(files, "game_id") if files else df.repartitionByRange("game_id")
    df.sortWithinPartitions("game_id").write.mode("overwrite").option("compression", "snappy").parquet(dst)
    if remove_parts:
        delete_paths(spark, parts)


def _convert(raw: DataFrame, out: str, sources: list[str]) -> dict[str, tuple[int, int, str | None]]:
    """Convert ``raw``, the games of ``sources``, into their own partitions of
    ``out``, games and rejects in one pass; other partitions are not touched.
    Returns the games, the rejects and a reason of every source that has any.

    Rows carry the name of the run, by which a partition of an earlier run that
    got no rows now is told apart and removed."""
    spark = raw.sparkSession
    run = uuid.uuid4().hex
    (sorted_out(pgn.parse_games(raw)).withColumn("run", F.lit(run))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .partitionBy("outcome", "source").parquet(out))
    parts = (spark.read.schema("run string, reason string, outcome string, source string").parquet(out).where(F.col("source").isin(sources))
             .groupBy("source", "outcome", "run").agg(F.count(F.lit(1)).alias("n"), F.min("reason").alias("reason")).collect())
    delete_paths(spark, [f"{out}/outcome={p.outcome}/source={escaped_name(spark, p.source)}" for p in parts if p.run != run])
    kept: dict[str, tuple[int, int, str | None]] = {}
    for p in parts:
        if p.run == run:
            games, rejects, reason = kept.get(p.source, (0, 0, None))
            kept[p.source] = (games + p.n, rejects, reason) if p.outcome == "games" else (games, rejects + p.n, p.reason)
    return kept


def convert_sources(spark: SparkSession, folder: str, out: str, sources: list[str],
                    glob: str | None = pgn.DEFAULT_GLOB) -> dict[str, tuple[int, int, str | None]]:
    """Convert the named sources of ``folder``; see ``_convert``."""
    return _convert(pgn.scan_pgn(spark, folder, glob=glob).where(F.col("source").isin(sources)), out, sources)


def convert_folder(spark: SparkSession, folder: str, out: str, glob: str | None = pgn.DEFAULT_GLOB,
                   force: bool = False) -> DataFrame:
    """Convert what needs it and say what became of every source.

    Sources whose target is up to date are skipped and stay as they are. All
    others are converted in one job, however many they are: their files are listed
    once, and a game that does not fit the games table becomes a row of the
    rejects (``read_rejects``). Only a file that cannot be read at all fails the
    job; the sources are then halved until it stands alone.

    Returns ``(source, status, games, rejects, error)`` with status converted,
    skipped, empty (no game), or failed (all rejected, or unreadable). The
    listing, one path per input file, is held by the driver.
    """
    target = out if path_exists(spark, out) else None
    plan = files_to_process(spark, folder, target, glob, force).orderBy("source").collect()
    rows: list[tuple] = [(r.source, "skipped", None, None, None) for r in plan if r.status == "skip"]

    def attempt(todo: list) -> None:
        paths = [literal_path(path) for r in todo for path in r.paths]
        names = [r.source for r in todo]
        try:
            kept = _convert(pgn.scan_pgn(spark, paths, glob=None, base_path=folder), out, names)
        except (PySparkException, Py4JError) as exc:
            if len(todo) == 1:
                rows.append((names[0], "failed", None, None, str(exc).splitlines()[0][:300]))
            else:
                attempt(todo[:len(todo) // 2])
                attempt(todo[len(todo) // 2:])
            return
        for name in names:
            games, rejects, reason = kept.get(name, (0, 0, None))
            rows.append((name, "converted" if games else "failed" if rejects else "empty", games, rejects, reason))

    todo = [r for r in plan if r.status == "convert"]
    if todo:
        attempt(todo)
    return spark.createDataFrame(rows, "source string, status string, games long, rejects long, error string")


def literal_path(path: str) -> str:
    """A path for a reader that takes patterns, with the signs of patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length, stem, source)`` of the files under
    ``folder`` (recursive). ``source`` is a ``source=`` / ``stem=`` folder
    value when present, else the file stem."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(folder).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    part = F.regexp_extract("path", r"/(?:source|stem)=([^/]+)/[^/]+$", 1)
    src = F.when(part != "", part).otherwise(stem)
    return df.withColumn("stem", stem).withColumn("source", src)


def files_to_process(spark: SparkSession, src_folder: str, target_folder: str | None,
                     glob: str | None = pgn.DEFAULT_GLOB, force: bool = False) -> DataFrame:
    """A source needs conversion when its target is missing or older than
    the newest source file, or when ``force`` is set."""
    src = list_files(spark, src_folder, glob).groupBy("source").agg(
        F.max("modificationTime").alias("src_mtime"), F.count(F.lit(1)).alias("files"), F.collect_list("path").alias("paths"))
    if target_folder is None:
        tgt = spark.createDataFrame([], "source string, tgt_mtime timestamp")
    else:
        tgt = list_files(spark, target_folder, "*.parquet").groupBy("source").agg(
            F.max("modificationTime").alias("tgt_mtime"))
    j = src.join(tgt, "source", "left")
    need = F.lit(force) | F.col("tgt_mtime").isNull() | (F.col("src_mtime") > F.col("tgt_mtime"))
    return j.select("source", "files", "paths", "src_mtime", "tgt_mtime",
                    F.when(need, F.lit("convert")).otherwise(F.lit("skip")).alias("status"))


def batch_status(outcome: DataFrame) -> DataFrame:
    """Outcome counts of a batch (``convert_folder``'s rows)."""
    return outcome.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def playable_games(docs: DataFrame, audio: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Documents that have an audio twin with the same stem, newest first.

    ``docs`` is ``(stem, modified)`` and ``audio`` ``(stem)``: listings of folders
    with a file per document (``listing``), or tables with a row per document.
    ``position`` is the place in the order; ``display`` is the stem unless
    ``aliases`` names it otherwise."""
    newest = docs.groupBy("stem").agg(F.max("modified").alias("modified"))
    j = newest.join(audio.select("stem"), "stem", "left_semi")
    display = F.col("stem")
    if aliases:
        m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        display = F.coalesce(F.try_element_at(m, F.col("stem")), F.col("stem"))
    return j.select("stem", "modified", display.alias("display")).orderBy(F.desc("modified"), "stem")


def listing(spark: SparkSession, folder: str, glob: str | None) -> DataFrame:
    """``(stem, modified)`` of a folder with a file per document."""
    return list_files(spark, folder, glob).select(F.col("source").alias("stem"), F.col("modificationTime").alias("modified"))


#: Beside the files of a PGN folder, in a folder that readers pass over: the ids of
#: the games, and the files that they are known of.
_IDS, _ID_FILES = "_ids/games", "_ids/files"
_ID_FILE = "path string, modified timestamp, length long"


def held_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ParquetGameId tags of a PGN folder, ``(game_id)``, out of its id table.

    Files that the table does not know, since somebody else or a run that died wrote
    them, are scanned for their ids first; if a known file has changed, all are."""
    listed = list_files(spark, folder).select("path", F.col("modificationTime").alias("modified"), "length")
    ids, known = f"{folder}/{_IDS}", f"{folder}/{_ID_FILES}"
    if path_exists(spark, known):
        seen = spark.read.schema(_ID_FILE).parquet(known)
        changed = seen.join(listed, ["path", "modified", "length"], "left_anti")
        if changed.isEmpty():
            listed = listed.join(seen, ["path", "modified", "length"], "left_anti")
        else:
            delete_paths(spark, [ids, known])
    new = [tuple(r) for r in listed.collect()]
    if new:
        tagged = pgn.with_tags(pgn.scan_pgn(spark, [literal_path(path) for path, _, _ in new], glob=None))
        found = tagged.select(pgn.tag(F.col("_keys"), F.col("_vals"), "ParquetGameId", "").try_cast("long").alias("game_id"))
        _add_ids(found.where("game_id IS NOT NULL").distinct(), folder)
        spark.createDataFrame(new, _ID_FILE).coalesce(1).write.mode("append").parquet(known)
    if not path_exists(spark, ids):
        return spark.createDataFrame([], "game_id long")
    return spark.read.schema("game_id long").parquet(ids)


def _add_ids(ids: DataFrame, folder: str) -> None:
    """Ids as a part of the id table, in ranges: a lookup passes over row groups by their bounds."""
    ids.repartitionByRange("game_id").sortWithinPartitions("game_id").write.mode("append").parquet(f"{folder}/{_IDS}")


def append_games(games: DataFrame, folder: str) -> DataFrame:
    """Append to a PGN folder the games that it does not hold yet, by their
    ParquetGameId tag. ``games`` is ``(game_id, pgn)``; a game that is given twice is
    appended once. Returns the ids that were appended.

    What the folder holds is read off its id table; no game in it is parsed again. The
    table is written after the text. A run that dies in between leaves files that the
    table does not know, which the next run looks through."""
    spark = games.sparkSession
    wanted = games.select(F.col("game_id").cast("long")).where("game_id IS NOT NULL").distinct()
    if path_exists(spark, folder):
        held = held_ids(spark, folder)
        # the few that are wanted pick their matches out of the many that are held
        wanted = stored(wanted, "append-wanted")
        wanted = wanted.join(held.join(wanted, "game_id", "left_semi"), "game_id", "left_anti")
    new = stored(wanted, "append-new")
    once = games.dropDuplicates(["game_id"]).join(new.select(F.col("game_id").alias("_new")), F.col("game_id").cast("long") == F.col("_new"), "left_semi")
    before = {r.path for r in list_files(spark, folder).select("path").collect()} if path_exists(spark, folder) else set()
    once.select("pgn").write.mode("append").text(folder)
    _add_ids(new, folder)
    made = list_files(spark, folder).select("path", "modificationTime", "length").collect()
    made = [tuple(r) for r in made if r.path not in before]
    if made:
        spark.createDataFrame(made, _ID_FILE).coalesce(1).write.mode("append").parquet(f"{folder}/{_ID_FILES}")
    return new


def base64_text(content: str) -> Column:
    """Binary as one line of base64; Spark breaks lines after 76 characters."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def file_base64(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Content of the files of a folder as base64 text. Files of 0 bytes are
    not listed: Spark's file sources pass them over."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder).select("path", "length", base64_text("content").alias("b64"))

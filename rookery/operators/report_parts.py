"""The report in parts: what every source adds to it, kept as a table.

All analyses read counts, frequencies, sums and maxima, which merge. So the games
of a source are read once, when the source is new or changed; they leave a narrow
part of the report (key counts, Elo frequencies, games and peak rating per player,
its strongest game), and the report merges the parts of all sources without a look
at older games.

A table of parts has two folders, each partitioned by source:

    counts    (dim, s0, s1, n, count, w, b, d, peak)
    strong    the columns of the strongest game
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import child_names, delete_paths, escaped_name, path_exists, unescaped_name
from ..sources.files import GAMES_SCHEMA
from . import report

COUNTS = "dim string, s0 string, s1 string, n double, count long, w long, b long, d long, peak long, source string"


def _side_keys() -> list:
    """One key for the game itself, and of each rated side its rating, with whether both are rated, and its player."""
    both = (F.col("white_elo") > 400) & (F.col("black_elo") > 400)
    keys = [report.key_struct("total", {})]
    for side in ("white", "black"):
        elo = F.col(f"{side}_elo")
        keys.append(F.when(elo > 0, report.key_struct("elo", {"s0": F.lit(side), "s1": both.cast("string"), "n": elo})))
        keys.append(F.when(elo > 0, report.key_struct("player", {"s0": F.col(side)}, elo)))
    return keys


def source_counts(games: DataFrame) -> DataFrame:
    """The counts of every source of ``games``, in one pass and one shuffle of narrow rows."""
    dimensions = [a.dimension for a in report.REPORT.values() if a.dimension in report.DIMENSIONS]
    keys = report.dimension_keys(games, list(dict.fromkeys(dimensions))) + _side_keys()
    rows = report.exploded_keys(games, keys, "source")
    return (rows.groupBy("source", "dim", "s0", "s1", "n")
            .agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).cast("long").alias(c) for c in "wbd"], F.max("peak").cast("long").alias("peak")))


def source_strongest(games: DataFrame) -> DataFrame:
    """The strongest game of every source; ties go to the lowest id."""
    strong = report.strong_games(games)
    best = F.max_by(F.struct(*report.TOP_GAME_COLUMNS), F.struct("total_elo", -F.col("game_id")))
    return strong.groupBy("source").agg(best.alias("g")).select("source", "g.*")


def update(games: DataFrame, path: str, sources: list[str]) -> None:
    """Write the parts of the named sources, read from ``games`` (a table with a
    ``source`` column, partitioned by it), over those they had; a source without
    games now loses its part. Other sources are neither read nor written."""
    spark = games.sparkSession
    new = games.where(F.col("source").isin(sources))
    # a source may have no row of a kind any more, so its old partitions go first. The
    # counts are written last: a source of a run that died has none, and is read again
    folders = {escaped_name(spark, s) for s in sources}
    for name in ("counts", "strong"):
        held = child_names(spark, f"{path}/{name}") if path_exists(spark, f"{path}/{name}") else []
        delete_paths(spark, [f"{path}/{name}/{n}" for n in held if n.removeprefix("source=") in folders])
    for name, rows in (("strong", source_strongest(new)), ("counts", source_counts(new))):
        rows.write.mode("append").partitionBy("source").parquet(f"{path}/{name}")


def known_sources(spark: SparkSession, path: str) -> set[str]:
    """The sources that have left a part, by its folders."""
    if not path_exists(spark, f"{path}/counts"):
        return set()
    return {unescaped_name(spark, n[len("source="):]) for n in child_names(spark, f"{path}/counts") if n.startswith("source=")}


def merged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What the analyses read, merged from the parts of all sources."""
    empty = spark.createDataFrame([], GAMES_SCHEMA)
    parts = spark.read.schema(COUNTS).parquet(f"{path}/counts") if path_exists(spark, f"{path}/counts") else spark.createDataFrame([], COUNTS)
    counts = (parts.groupBy("dim", "s0", "s1", "n")
              .agg(*[F.sum(c).alias(c) for c in ("count", "w", "b", "d")], F.max("peak").alias("peak")))
    out = {name: report.keyed_counts(empty, counts, name) for name in report.DIMENSIONS}
    out["total"] = counts.where("dim = 'total'").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    out["elo"] = counts.where("dim = 'elo'").select(F.col("s0").alias("side"), F.col("n").cast("smallint").alias("elo"),
                                                    F.col("s1").cast("boolean").alias("both_rated"), "count")
    out["player"] = counts.where("dim = 'player'").select(F.col("s0").alias("player"), F.col("count").alias("games"),
                                                          F.col("peak").cast("smallint").alias("peak_elo"))
    strong = report.strong_games(empty).select(*report.TOP_GAME_COLUMNS)
    if path_exists(spark, f"{path}/strong"):
        strong = spark.read.schema(strong.schema).parquet(f"{path}/strong").select(*report.TOP_GAME_COLUMNS)
    return out | {"strong": strong}

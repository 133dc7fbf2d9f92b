"""PGN files derived from the test tables, written once per session and input.

The test tables hold no PGN, so the ingest queries first render ``games`` (or
``plies``) to PGN text with Spark and write it below the shared folder
(``spark.checkpoint.dir``); the scans then read those files like any PGN dump.
Files are range-partitioned by (source, game id) so part-file order is game
order, one folder per source.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pgn_render import render_annotated, render_games
from ..session import path_exists, work_path
from . import testdata as td

_DONE: dict[tuple[str, str, str], str] = {}
_LOCK = threading.Lock()   # queries may be built from several driver threads


def source_name(event) -> F.Column:
    """Folder-safe source name from an event title ('Rated game 0' -> 'rated_game_0')."""
    return F.regexp_replace(F.lower(F.col(event) if isinstance(event, str) else event), r"[^a-z0-9]+", "_")


def in_file_order(games: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by (source, game_id) so part files come out in
    game order. Done on the narrow input, before any text is rendered, so the
    range sampling does not render twice."""
    df = games.repartitionByRange(partitions, "source", "game_id") if partitions \
        else games.repartitionByRange("source", "game_id")
    return df.sortWithinPartitions("source", "game_id")


def write_pgn(pgn: DataFrame, path: str, compression: str = "none") -> None:
    """Write ``(source, pgn)`` as text, one folder per source."""
    pgn.select("source", "pgn").write.mode("overwrite").option("compression", compression).partitionBy("source").text(path)


def _key(spark: SparkSession, sf_dir: str, kind: str) -> tuple[str, str, str]:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind)


def _path(spark: SparkSession, sf_dir: str, kind: str) -> str:
    # by application as well: two that share the folder do not meet
    h = hashlib.sha1("|".join(_key(spark, sf_dir, kind)).encode()).hexdigest()[:16]
    return work_path(spark, "pgn", f"{kind}-{h}")


def _build(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    """Write a corpus once per application and input; later calls reuse it."""
    key, path = _key(spark, sf_dir, kind), _path(spark, sf_dir, kind)
    with _LOCK:
        if key not in _DONE or not path_exists(spark, path + "/_SUCCESS"):
            write(path)
            _DONE[key] = path
    return path


# Eight side lines in one another, with a comment that holds brackets.
SIDE_LINES = "(1. a3 {say (\"no\")} " * 8 + "1... a6" + ")" * 8


def varied(pgn: DataFrame) -> DataFrame:
    """The sources as different writers leave them: one with CRLF line ends, one
    with deeply nested side lines, one without blank lines between games."""
    text, source = F.col("pgn"), F.col("source")
    tags, moves = F.substring_index(text, "\n\n", 1), F.substring_index(text, "\n\n", -1)
    first = r"^(1\. \S+(?: \{[^}]*\})?)"
    deep = F.concat(tags, F.lit("\n\n"), F.regexp_replace(moves, first, f"$1 {SIDE_LINES}"))
    return pgn.withColumn("pgn", F.when(source.endswith("1"), F.regexp_replace(text, "\n", "\r\n"))
                          .when(source.endswith("2"), deep)
                          .when(source.endswith("3"), F.regexp_replace(text, r"\n+$", "")).otherwise(text))


#: Games of a packed file, which one task reads, and of the sort in front of it.
PACKED_GAMES = 250_000


def games_corpus(spark: SparkSession, sf_dir: str, packed: bool = False) -> str:
    """All games rendered to PGN, one source per event title, each in a layout of its own.

    ``packed`` files are gzipped and of bounded size, since a task reads a packed file
    whole; plain files can be split, and are as large as the shuffle makes them."""
    def write(path: str) -> None:
        games = td.games(spark, sf_dir).withColumn("source", source_name("event"))
        files = max(spark.sparkContext.defaultParallelism, -(-games.count() // PACKED_GAMES)) if packed else None
        write_pgn(varied(render_games(in_file_order(games, files), keep=("source",))), path, "gzip" if packed else "none")
    return _build(spark, sf_dir, "games-packed" if packed else "games", write)


def annotated_corpus(spark: SparkSession, sf_dir: str) -> str:
    """Every scored game of ``plies`` as annotated PGN (``[%eval]`` per ply)."""
    def write(path: str) -> None:
        pgn = render_annotated(td.games(spark, sf_dir), td.plies(spark, sf_dir))
        write_pgn(pgn.withColumn("source", F.lit("annotated")), path)
    return _build(spark, sf_dir, "annotated", write)

"""Plies and games stored by game: the per-ply features without any exchange.

Every feature of a move looks at the other moves of its game, and every document
joins a game's moves with its names. A store keeps both tables bucketed by game and
sorted by ply, with one number of buckets that follows from the number of plies; all
of that then runs where the rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import bucketed

#: Plies of one bucket, and so of one task.
BUCKET_PLIES = 4_000_000


def buckets_for(plies: DataFrame, per_bucket: int = BUCKET_PLIES) -> int:
    return max(1, -(-plies.count() // per_bucket))


def store(games: DataFrame, plies: DataFrame, folder: str, per_bucket: int = BUCKET_PLIES) -> tuple[DataFrame, DataFrame]:
    """Write both tables below ``folder``; returns them as (games, plies) read in place.

    Each is shuffled once, by game, so that a bucket is one file."""
    n = buckets_for(plies, per_bucket)

    def put(df: DataFrame, name: str, *sort: str) -> DataFrame:
        return bucketed(df.repartition(n, "game_id"), "game_id", n, f"{folder}/{name}", sort)

    return put(games, "games", "game_id"), put(plies, "plies", "game_id", "ply")

"""Games by player: one player's games without a scan of all.

An index holds a narrow row per game and side, sorted by player, in small row groups
with a bloom filter on the player. A read of one player's games then opens the row
groups whose range of names and filter let the name through: a few, however many
games there are. Batches append to an index; a row group of any batch is passed over
by its own range and filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("player string, side string, game_id int, white string, black string, result string, white_elo smallint, "
          "black_elo smallint, date string, eco string, opening string, num_moves smallint, moves_uci string")
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")][2:]

#: Bytes of a row group, and players that its filter is laid out for.
GROUP_BYTES = 4 << 20
GROUP_PLAYERS = 20_000


def write_player_index(games: DataFrame, path: str, mode: str = "overwrite", group_bytes: int = GROUP_BYTES) -> None:
    """Two rows per game, one for self-play, ranged and sorted by player and game: a
    player with a large part of all games fills several files."""
    base = games.select(*_COLUMNS)
    rows = base.select(F.explode(F.when(F.col("white").eqNullSafe(F.col("black")), F.array(F.lit("white"))).otherwise(F.array(F.lit("white"), F.lit("black")))).alias("side"), "*")
    rows = rows.select(F.when(F.col("side") == "white", F.col("white")).otherwise(F.col("black")).alias("player"), "side", *_COLUMNS)
    (rows.repartitionByRange("player", "game_id").sortWithinPartitions("player", "game_id").write.mode(mode)
     .option("parquet.block.size", group_bytes)
     .option("parquet.block.size.row.check.min", 1000).option("parquet.page.size.row.check.min", 1000)
     .option("parquet.bloom.filter.enabled#player", "true").option("parquet.bloom.filter.expected.ndv#player", GROUP_PLAYERS)
     .parquet(path))


def games_of_player(spark: SparkSession, path: str, player: str) -> DataFrame:
    """The games of one player, once each (C3), with the side that they had."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("player") == player)

"""Opening repertoire roll-up for every player at once.

The reference builds this for one player in a Python loop. Here each game turns
into at most two (player, side) rows in one scan (self-play counts once, as
White), partial aggregation shrinks them per task, and the hierarchy levels come
out of a single ``GROUPING SETS`` aggregate. A player with a third of all games
is harmless: the map-side partial aggregate leaves at most one row per
(player, side, group, eco) and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# First-move groups (UCI -> label, White's view). Black's label is
# "vs " + White's. Any other first move falls into the 'other' group.
FIRST_MOVE_GROUPS = (("e2e4", "1.e4"), ("d2d4", "1.d4"), ("c2c4", "1.c4"), ("g1f3", "1.Nf3"))
OTHER_FIRST_MOVE = "1.other"
MISSING_ECO = "N/A"
OTHER_ECO = "other"
MIN_ECO_GAMES = 8          # ECOs with fewer games fold into 'other' (per group)
WINRATE_RANGE_FLOOR = 1e-6


def first_move(moves_uci: Column | str = "moves_uci") -> Column:
    c = F.col(moves_uci) if isinstance(moves_uci, str) else moves_uci
    return F.split_part(c, F.lit(" "), F.lit(1))


def move_group(fm: Column, side: Column) -> Column:
    """First move -> group label from the side's view."""
    expr = None
    for uci, label in FIRST_MOVE_GROUPS:
        expr = F.when(fm == uci, F.lit(label)) if expr is None else expr.when(fm == uci, F.lit(label))
    white_label = expr.otherwise(F.lit(OTHER_FIRST_MOVE))
    return F.when(side == "white", white_label).otherwise(F.concat(F.lit("vs "), white_label))


def eco3(eco: Column | str = "eco") -> Column:
    c = F.col(eco) if isinstance(eco, str) else eco
    return F.when(c.isNull() | (c == ""), F.lit(MISSING_ECO)).otherwise(F.substring(c, 1, 3))


def player_sides(games: DataFrame) -> DataFrame:
    """C3 for all players: one row per (game, player side) with W/L/D from that
    player's view. Games without moves are skipped; self-play counts as White."""
    base = games.where(first_move() != "").select(
        "white", "black", "result", eco3().alias("eco3"), first_move().alias("fm"))

    def side(s: str, win: str, loss: str) -> Column:
        r = F.col("result")
        return F.struct(F.col(s).alias("player"), F.lit(s).alias("side"),
                        (r == win).alias("win"), (r == loss).alias("loss"),
                        (~r.isin("1-0", "0-1")).alias("draw"))
    rows = base.select("eco3", "fm", "white", F.inline(F.array(side("white", "1-0", "0-1"),
                                                              side("black", "0-1", "1-0"))))
    rows = rows.where((F.col("side") == "white") | (F.col("player") != F.col("white")))
    return rows.select("player", "side", move_group(F.col("fm"), F.col("side")).alias("grp"),
                       "eco3", "win", "loss", "draw")


def _wld() -> list[Column]:
    return [F.count(F.lit(1)).alias("games"), F.count_if("win").alias("wins"),
            F.count_if("loss").alias("losses"), F.count_if("draw").alias("draws")]


# D18
def repertoire_leaf(games: DataFrame) -> DataFrame:
    return player_sides(games).groupBy("player", "side", "grp", "eco3").agg(*_wld())


def _sum_wld() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in ("games", "wins", "losses", "draws")]


def _hover_pcts() -> list[Column]:
    n = F.col("games")
    return [F.when(n > 0, F.bround(F.lit(100.0) * F.col(c) / n, 0)).alias(f"{c}_pct")
            for c in ("wins", "losses", "draws")]


def sides_of_player(rows: DataFrame) -> DataFrame:
    """``player_sides`` from rows of a player index (``sources.players``), which are
    one per game and side already."""
    win = F.when(F.col("side") == "white", F.lit("1-0")).otherwise(F.lit("0-1"))
    loss = F.when(F.col("side") == "white", F.lit("0-1")).otherwise(F.lit("1-0"))
    r = F.col("result")
    return rows.where(first_move() != "").select(
        "player", "side", move_group(first_move(), F.col("side")).alias("grp"), eco3().alias("eco3"),
        (r == win).alias("win"), (r == loss).alias("loss"), (~r.isin("1-0", "0-1")).alias("draw"))


# D19
def repertoire_nodes(games: DataFrame, min_eco_games: int = MIN_ECO_GAMES) -> DataFrame:
    """Hierarchy side -> first-move group -> ECO, small ECOs folded into 'other'
    per group. Both side roots exist for every player, also with 0 games."""
    return nodes_of_leaf(repertoire_leaf(games), min_eco_games)


def repertoire_one_player(rows: DataFrame, min_eco_games: int = MIN_ECO_GAMES) -> DataFrame:
    """``repertoire_nodes`` of the player whose index rows are given."""
    return nodes_of_leaf(sides_of_player(rows).groupBy("player", "side", "grp", "eco3").agg(*_wld()), min_eco_games)


def nodes_of_leaf(leaf: DataFrame, min_eco_games: int) -> DataFrame:
    folded = leaf.withColumn(
        "label", F.when(F.col("games") >= min_eco_games, F.col("eco3")).otherwise(F.lit(OTHER_ECO)))
    inner = (folded.groupingSets([["player", "side", "grp", "label"], ["player", "side", "grp"]],
                                 "player", "side", "grp", "label")
             .agg(*_sum_wld(), F.grouping("label").alias("_g"))
             .select("player",
                     F.when(F.col("_g") == 1, F.lit("group")).otherwise(F.lit("eco")).alias("level"),
                     "side", "grp", "label", "games", "wins", "losses", "draws"))

    def root(s: str) -> Column:
        return F.struct(F.lit("side").alias("level"), F.lit(s).alias("side"),
                        F.lit(None).cast("string").alias("grp"), F.lit(None).cast("string").alias("label"),
                        *[F.col(f"{s}_{c}").alias(c) for c in ("games", "wins", "losses", "draws")])
    sums = leaf.groupBy("player").agg(*[
        F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0)).cast("long").alias(f"{s}_{c}")
        for s in ("white", "black") for c in ("games", "wins", "losses", "draws")])
    roots = sums.select("player", F.inline(F.array(root("white"), root("black"))))
    nodes = inner.unionByName(roots)
    return nodes.select(
        "player", "level", "side", "grp", "label",
        F.coalesce("label", "grp", "side").alias("node"),
        F.concat_ws("/", "side", "grp", "label").alias("node_id"),
        "games", "wins", "losses", "draws",
        F.when(F.col("level") != "side", F.try_divide(F.col("wins"), F.col("games"))).alias("win_rate"),
        *_hover_pcts())


# Min-max normalised win rate per player over all non-root nodes
def repertoire_winrate_norm(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("player")
    lo = F.min("win_rate").over(w)
    hi = F.max("win_rate").over(w)
    return nodes.select("player", "node_id", "level", "win_rate",
                        ((F.col("win_rate") - lo) / F.greatest(hi - lo, F.lit(WINRATE_RANGE_FLOOR)))
                        .alias("win_rate_norm"))


# Edges root -> group -> leaf with count and W/L/D
def repertoire_edges(nodes: DataFrame) -> DataFrame:
    inner = nodes.where(F.col("level") != "side")
    src = F.when(F.col("level") == "group", F.col("side")) \
        .otherwise(F.concat_ws("/", "side", "grp"))
    return inner.select("player", src.alias("src"), F.col("node_id").alias("tgt"),
                        F.col("games").alias("value"), "wins", "losses", "draws")


# order of the nodes under their parent
def repertoire_order(nodes: DataFrame) -> DataFrame:
    """Groups of a side and ECOs of a group by games, most first, then by name:
    ``position`` counts from 1 within the parent. One window per (player,
    parent), which holds the few labels of one node."""
    inner = nodes.where(F.col("level") != "side")
    parent = F.when(F.col("level") == "group", F.col("side")).otherwise(F.concat_ws("/", "side", "grp"))
    order = Window.partitionBy("player", "parent").orderBy(F.desc("games"), "node")
    return (inner.withColumn("parent", parent)
            .select("player", "parent", F.row_number().over(order).alias("position"), "node_id", "games"))


# ECO -> label, falling back to the code. The label table is derived from the
# games themselves: the most frequent opening name per 3-character ECO.
def eco_label_table(games: DataFrame) -> DataFrame:
    named = games.where(F.col("opening") != "").select(eco3().alias("eco3"), "opening")
    counts = named.groupBy("eco3", "opening").agg(F.count(F.lit(1)).alias("n"))
    # most games first, then the alphabetically first name
    return counts.groupBy("eco3").agg(
        F.min_by("opening", F.struct(-F.col("n"), F.col("opening"))).alias("eco_name"))


def label_leaves(leaf: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join leaves with the label table; the planner chooses how."""
    return (leaf.join(labels, "eco3", "left")
            .withColumn("eco_name", F.coalesce(F.col("eco_name"), F.col("eco3"))))

"""Repertoire queries D18-D20, E10, C1 (all players at once)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import repertoire as rp
from ..operators import report
from ..session import fresh_path
from ..sources import players
from ..sources import testdata as td
from .catalog import register
from .report_sql import REPORT_SQL

_GRP = """CASE fm WHEN 'e2e4' THEN '1.e4' WHEN 'd2d4' THEN '1.d4' WHEN 'c2c4' THEN '1.c4'
               WHEN 'g1f3' THEN '1.Nf3' ELSE '1.other' END"""

LEAF_CTE = f"""
, base AS (
  SELECT white, black, result, CASE WHEN eco = '' THEN 'N/A' ELSE substr(eco, 1, 3) END AS eco3,
         split_part(moves_uci, ' ', 1) AS fm
  FROM games WHERE split_part(moves_uci, ' ', 1) != '')
, sides AS (
  SELECT white AS player, 'white' AS side, {_GRP} AS grp, eco3,
         CASE WHEN result = '1-0' THEN 1 ELSE 0 END AS w, CASE WHEN result = '0-1' THEN 1 ELSE 0 END AS l,
         CASE WHEN result NOT IN ('1-0', '0-1') THEN 1 ELSE 0 END AS d
  FROM base
  UNION ALL
  SELECT black, 'black', 'vs ' || {_GRP}, eco3,
         CASE WHEN result = '0-1' THEN 1 ELSE 0 END, CASE WHEN result = '1-0' THEN 1 ELSE 0 END,
         CASE WHEN result NOT IN ('1-0', '0-1') THEN 1 ELSE 0 END
  FROM base WHERE black != white)
, leaf AS (
  SELECT player, side, grp, eco3, COUNT(*) AS games, CAST(SUM(w) AS BIGINT) AS wins,
         CAST(SUM(l) AS BIGINT) AS losses, CAST(SUM(d) AS BIGINT) AS draws
  FROM sides GROUP BY player, side, grp, eco3)
"""

NODES_CTE = LEAF_CTE + """
, folded AS (SELECT *, CASE WHEN games >= 8 THEN eco3 ELSE 'other' END AS label FROM leaf)
, inner_nodes AS (
  SELECT player, CASE WHEN GROUPING(label) = 1 THEN 'group' ELSE 'eco' END AS level, side, grp, label,
         CAST(SUM(games) AS BIGINT) AS games, CAST(SUM(wins) AS BIGINT) AS wins,
         CAST(SUM(losses) AS BIGINT) AS losses, CAST(SUM(draws) AS BIGINT) AS draws
  FROM folded GROUP BY GROUPING SETS ((player, side, grp, label), (player, side, grp)))
, players AS (SELECT DISTINCT player FROM leaf)
, roots AS (
  SELECT p.player, 'side' AS level, s.side, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS VARCHAR) AS label,
         CAST(COALESCE(SUM(l.games), 0) AS BIGINT) AS games, CAST(COALESCE(SUM(l.wins), 0) AS BIGINT) AS wins,
         CAST(COALESCE(SUM(l.losses), 0) AS BIGINT) AS losses, CAST(COALESCE(SUM(l.draws), 0) AS BIGINT) AS draws
  FROM players p CROSS JOIN (VALUES ('white'), ('black')) s(side)
  LEFT JOIN leaf l ON l.player = p.player AND l.side = s.side
  GROUP BY p.player, s.side)
, all_nodes AS (SELECT * FROM inner_nodes UNION ALL SELECT * FROM roots)
, nodes AS (
  SELECT player, level, side, grp, label, COALESCE(label, grp, side) AS node,
         concat_ws('/', side, grp, label) AS node_id, games, wins, losses, draws,
         CASE WHEN level != 'side' AND games > 0 THEN wins / games END AS win_rate,
         CASE WHEN games > 0 THEN CAST(ROUND_EVEN(100.0 * wins / games, 0) AS DOUBLE) END AS wins_pct,
         CASE WHEN games > 0 THEN CAST(ROUND_EVEN(100.0 * losses / games, 0) AS DOUBLE) END AS losses_pct,
         CASE WHEN games > 0 THEN CAST(ROUND_EVEN(100.0 * draws / games, 0) AS DOUBLE) END AS draws_pct
  FROM all_nodes)
"""


def _games(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(td.games(spark, sf_dir))
    return build


register("repertoire_leaf", _games(rp.repertoire_leaf),
         LEAF_CTE + "SELECT * FROM leaf", ("games",))
register("repertoire_nodes", _games(rp.repertoire_nodes),
         NODES_CTE + "SELECT * FROM nodes", ("games",))
register("repertoire_winrate_norm", _games(lambda g: rp.repertoire_winrate_norm(rp.repertoire_nodes(g))),
         NODES_CTE + """
SELECT player, node_id, level, win_rate,
       (win_rate - MIN(win_rate) OVER (PARTITION BY player))
       / GREATEST(MAX(win_rate) OVER (PARTITION BY player) - MIN(win_rate) OVER (PARTITION BY player), 1e-6)
       AS win_rate_norm
FROM nodes""", ("games",))
register("repertoire_edges", _games(lambda g: rp.repertoire_edges(rp.repertoire_nodes(g))),
         NODES_CTE + """
SELECT player, CASE WHEN level = 'group' THEN side ELSE concat_ws('/', side, grp) END AS src,
       node_id AS tgt, games AS value, wins, losses, draws
FROM nodes WHERE level != 'side'""", ("games",))


def _one_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repertoire of the player with most games, read from an index by player."""
    games = td.games(spark, sf_dir)
    path = fresh_path(spark, "player-index")
    players.write_player_index(games, path)
    name = report.focus_player(games).first().player
    return rp.repertoire_one_player(players.games_of_player(spark, path, name))


register("repertoire_one_player", _one_player, NODES_CTE + f"""
SELECT * FROM nodes WHERE player = (SELECT player FROM ({REPORT_SQL['focus_player']}))""", ("games",))
register("repertoire_order", _games(lambda g: rp.repertoire_order(rp.repertoire_nodes(g))),
         NODES_CTE + """
, kids AS (SELECT *, CASE WHEN level = 'group' THEN side ELSE side || '/' || grp END AS parent FROM nodes WHERE level != 'side')
SELECT player, parent, CAST(row_number() OVER (PARTITION BY player, parent ORDER BY games DESC, node) AS INT) AS position, node_id, games
FROM kids""", ("games",))


def _eco_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = td.games(spark, sf_dir)
    return rp.label_leaves(rp.repertoire_leaf(g), rp.eco_label_table(g)) \
        .select("player", "side", "grp", "eco3", "eco_name", "games")


register("eco_labels", _eco_labels, LEAF_CTE + """
, named AS (
  SELECT CASE WHEN eco = '' THEN 'N/A' ELSE substr(eco, 1, 3) END AS eco3, opening, COUNT(*) AS n
  FROM games WHERE opening != '' GROUP BY 1, 2)
, labels AS (SELECT eco3, arg_min(opening, (-n, opening)) AS eco_name FROM named GROUP BY eco3)
SELECT l.player, l.side, l.grp, l.eco3, COALESCE(b.eco_name, l.eco3) AS eco_name, l.games
FROM leaf l LEFT JOIN labels b ON l.eco3 = b.eco3""", ("games",))

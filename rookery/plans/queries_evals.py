"""Evaluation-feature queries over the ``plies`` view (all games at once)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evals as ev
from ..session import fresh_path
from ..sources import plies
from ..sources import testdata as td
from .catalog import register

EFF = "COALESCE(cp, CASE WHEN mate > 0 THEN 10000 WHEN mate IS NOT NULL THEN -10000 END, 0)"

DIFF_CTE = f"""
, e AS (SELECT *, {EFF} AS eff_cp FROM plies)
, d AS (
  SELECT game_id, ply, san, best_san, fen, cp, mate,
         CAST(FLOOR(ply / 2) + 1 AS INT) AS move_number,
         CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END AS color,
         eff_cp, eff_cp - COALESCE(LAG(eff_cp) OVER (PARTITION BY game_id ORDER BY ply), eff_cp) AS diff,
         COUNT(*) OVER (PARTITION BY game_id) AS n_plies
  FROM e)
, dd AS (
  SELECT *,
         CASE WHEN color = 'black' AND diff > 80 THEN 'black'
              WHEN color = 'white' AND diff < -80 THEN 'white' END AS blame,
         CASE WHEN move_number <= 8 THEN 'opening' WHEN ply >= n_plies - 3 THEN 'final' ELSE '' END AS tag
  FROM d)
"""

EVAL_CTE = f"""
, a AS (SELECT *, {EFF} AS eval_after FROM plies)
, b AS (SELECT *, COALESCE(LAG(eval_after) OVER (PARTITION BY game_id ORDER BY ply), 0) AS eval_before FROM a)
, c AS (SELECT *, CASE WHEN ply % 2 = 0 THEN eval_after - eval_before ELSE eval_before - eval_after END
                  AS signed_change FROM b)
, ev AS (
  SELECT game_id, ply, uci, best_uci, eval_before, eval_after, signed_change, ABS(signed_change) AS cp_loss,
         ROUND_EVEN(1 / (1 + EXP(-CAST(eval_before AS DOUBLE) / 400.0)), 4) AS win_prob_before,
         ROUND_EVEN(1 / (1 + EXP(-CAST(eval_after AS DOUBLE) / 400.0)), 4) AS win_prob_after,
         COALESCE(uci = best_uci, false) AS is_best,
         CASE WHEN signed_change < -200 THEN 'blunder' WHEN signed_change < -100 THEN 'mistake'
              WHEN signed_change < -50 THEN 'inaccuracy'
              WHEN COALESCE(uci = best_uci, false) THEN 'good' ELSE 'ok' END AS quality
  FROM c)
"""


def _plies(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(td.plies(spark, sf_dir))
    return build


def _games_plies(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(td.games(spark, sf_dir), td.plies(spark, sf_dir))
    return build


DIFF_COLS = ["game_id", "ply", "move_number", "color", "eff_cp", "diff", "n_plies", "blame", "tag"]

register("eval_diffs", _plies(lambda p: ev.eval_diffs(p).select(*DIFF_COLS)),
         DIFF_CTE + f"SELECT {', '.join(DIFF_COLS)} FROM dd", ("plies",))
register("blame", _plies(lambda p: ev.eval_diffs(p).select("game_id", "ply", "color", "diff", "blame")),
         DIFF_CTE + "SELECT game_id, ply, color, diff, blame FROM dd", ("plies",))
register("move_tags", _plies(lambda p: ev.eval_diffs(p).select("game_id", "ply", "move_number", "tag")),
         DIFF_CTE + "SELECT game_id, ply, move_number, tag FROM dd", ("plies",))

register("cp_loss", _plies(lambda p: ev.ply_evaluations(p).select(
    "game_id", "ply", "eval_before", "eval_after", "signed_change", "cp_loss")),
    EVAL_CTE + "SELECT game_id, ply, eval_before, eval_after, signed_change, cp_loss FROM ev", ("plies",))
MOST_PLIES = 12
register("cp_loss_bounded", _plies(lambda p: ev.ply_evaluations(p, max_plies=MOST_PLIES).select("game_id", "ply", "eval_before", "eval_after", "cp_loss", "quality")),
         EVAL_CTE + f"SELECT game_id, ply, eval_before, eval_after, cp_loss, quality FROM ev WHERE ply < {MOST_PLIES}", ("plies",))
register("win_probability", _plies(lambda p: ev.ply_evaluations(p).select(
    "game_id", "ply", "win_prob_before", "win_prob_after")),
    EVAL_CTE + "SELECT game_id, ply, win_prob_before, win_prob_after FROM ev", ("plies",))
register("move_quality", _plies(lambda p: ev.ply_evaluations(p).select("game_id", "ply", "is_best", "quality")),
         EVAL_CTE + "SELECT game_id, ply, is_best, quality FROM ev", ("plies",))

register("turning_points", _plies(ev.turning_points), DIFF_CTE + """
, g AS (SELECT game_id, COUNT(*) AS n_plies FROM dd GROUP BY game_id)
, t AS (SELECT game_id, ply, diff FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ABS(diff) DESC, ply) AS rk
          FROM dd WHERE ply >= LEAST(5, n_plies)) WHERE rk = 1)
, l AS (SELECT game_id, diff FROM dd WHERE ply = n_plies - 1)
SELECT g.game_id, g.n_plies, CAST(COALESCE(t.ply, g.n_plies - 1) AS INT) AS turning_ply,
       COALESCE(t.diff, l.diff) AS turning_diff
FROM g LEFT JOIN t ON g.game_id = t.game_id LEFT JOIN l ON g.game_id = l.game_id""", ("plies",))

register("top_mistakes", _plies(ev.top_mistakes), EVAL_CTE + """
SELECT game_id, CAST(rk AS INT) AS rank, ply, uci, best_uci, cp_loss, quality FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY cp_loss DESC, ply) AS rk
  FROM ev WHERE quality IN ('inaccuracy', 'mistake', 'blunder')) WHERE rk <= 5""", ("plies",))

register("worst_blunder", _plies(ev.worst_blunder), DIFF_CTE + """
SELECT game_id, ply, move_number, color, san, diff, blame FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ABS(diff) DESC, ply) AS rk
  FROM dd WHERE blame IS NOT NULL AND ply >= LEAST(5, n_plies)) WHERE rk = 1""", ("plies",))

register("eval_summary", _plies(ev.eval_summary), EVAL_CTE + """
SELECT game_id, COUNT(*) AS total_moves_analyzed,
       COUNT(*) FILTER (WHERE quality IN ('mistake', 'blunder')) AS mistakes,
       COUNT(*) FILTER (WHERE quality = 'blunder') AS blunders,
       ROUND_EVEN(AVG(cp_loss), 1) AS avg_cp_loss
FROM ev GROUP BY game_id""", ("plies",))

register("narration_target", _plies(ev.narration_target), """
SELECT game_id, COUNT(*) AS n_plies, CAST(GREATEST(250, LEAST(650, COUNT(*) * 12 + 50)) AS INT) AS target_words
FROM plies GROUP BY game_id""", ("plies",))

register("score_white_view", _plies(ev.score_white_view), """
SELECT game_id, ply, cp * CASE WHEN ply % 2 = 0 THEN -1 ELSE 1 END AS cp_white,
       mate * CASE WHEN ply % 2 = 0 THEN -1 ELSE 1 END AS mate_white,
       CAST(COALESCE(cp * CASE WHEN ply % 2 = 0 THEN -1 ELSE 1 END,
                CASE WHEN mate * CASE WHEN ply % 2 = 0 THEN -1 ELSE 1 END > 0 THEN 10000
                     WHEN mate * CASE WHEN ply % 2 = 0 THEN -1 ELSE 1 END < 0 THEN -10000
                     WHEN mate = 0 THEN CASE WHEN ply % 2 = 0 THEN 10000 ELSE -10000 END END,
                0) AS INT) AS eff_white
FROM plies""", ("plies",))

register("position_key", _plies(ev.position_keys), r"""
SELECT game_id, ply, array_to_string(list_slice(string_split_regex(trim(fen), '\s+'), 1, 4), ' ') AS position_key
FROM plies""", ("plies",))

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def _document_rows(games: DataFrame, plies: DataFrame) -> DataFrame:
    docs = ev.game_documents(games, plies)
    return docs.select("game_id", "white", "black", F.posexplode("moves").alias("idx", "m")) \
        .select("game_id", "white", "black", "idx", "m.move_number", "m.color", "m.san", "m.fen")


register("game_document", _games_plies(_document_rows), f"""
, names AS (SELECT game_id, white, black FROM games)
, pg AS (SELECT DISTINCT game_id FROM plies)
, docs AS (
  SELECT pg.game_id, COALESCE(n.white, 'White') AS white, COALESCE(n.black, 'Black') AS black
  FROM pg LEFT JOIN names n ON pg.game_id = n.game_id)
SELECT d.game_id, d.white, d.black, 0 AS idx, 0 AS move_number, 'start' AS color, '' AS san,
       '{START}' AS fen
FROM docs d
UNION ALL
SELECT d.game_id, d.white, d.black, p.ply + 1, CAST(FLOOR(p.ply / 2) + 1 AS INT),
       CASE WHEN p.ply % 2 = 0 THEN 'white' ELSE 'black' END, p.san, p.fen
FROM docs d JOIN plies p ON d.game_id = p.game_id""", ("games", "plies"))

register("document_ply_count", _plies(ev.ply_counts), """
SELECT game_id, CAST(COUNT(*) + 1 AS INT) AS shown_moves, CAST(COUNT(*) AS INT) AS plies
FROM plies GROUP BY game_id""", ("plies",))

register("final_position", _plies(ev.final_positions), """
SELECT game_id, arg_max(fen, ply) AS final_fen FROM plies GROUP BY game_id""", ("plies",))


def _evaluation_rows(games: DataFrame, plies: DataFrame) -> DataFrame:
    """The documents, written as packed JSON, read back and laid out by ply."""
    docs = ev.evaluation_documents(games, plies)
    path = fresh_path(games.sparkSession, "evaluations")
    docs.write.option("compression", "gzip").json(path)
    docs = games.sparkSession.read.schema(docs.schema).json(path)
    top = F.transform("top_mistakes", lambda m: m["ply"])
    return docs.select("game_id", "plies", F.size("best_moves").alias("n_best"), "summary.*", top.alias("top"), F.explode("evaluations").alias("e")) \
        .select("game_id", "plies", "n_best", "total_moves_analyzed", "mistakes", "blunders", "avg_cp_loss", "e.ply", "e.player",
                "e.fen_before", "e.fen_after", "e.cp_loss", "e.win_prob_after", "e.quality",
                F.array_position("top", F.col("e.ply")).cast("int").alias("mistake_rank"))


register("evaluation_document", _games_plies(_evaluation_rows), EVAL_CTE + f"""
, z AS (
  SELECT ev.*, p.fen, lag(p.fen) OVER (PARTITION BY ev.game_id ORDER BY ev.ply) AS before,
         max(CASE WHEN p.cp IS NOT NULL OR p.mate IS NOT NULL THEN ev.ply END) OVER (PARTITION BY ev.game_id) AS last_scored, p.best_uci AS b
  FROM ev JOIN plies p ON ev.game_id = p.game_id AND ev.ply = p.ply)
, q AS (SELECT * EXCLUDE (quality), CASE WHEN ply <= last_scored THEN quality END AS quality FROM z)
, m AS (SELECT game_id, ply, CAST(row_number() OVER (PARTITION BY game_id ORDER BY cp_loss DESC, ply) AS INT) AS rk FROM q
        WHERE quality IN ('inaccuracy', 'mistake', 'blunder'))
, s AS (SELECT game_id, count(*) AS plies, CAST(count(*) FILTER (b <> '') AS INT) AS n_best, count(*) FILTER (ply <= last_scored) AS total_moves_analyzed,
               count(*) FILTER (quality IN ('mistake', 'blunder')) AS mistakes, count(*) FILTER (quality = 'blunder') AS blunders,
               round_even(avg(cp_loss) FILTER (ply <= last_scored), 1) AS avg_cp_loss
        FROM q GROUP BY game_id)
SELECT s.*, q.ply, CASE WHEN q.ply % 2 = 0 THEN coalesce(g.white, 'White') ELSE coalesce(g.black, 'Black') END AS player,
       coalesce(q.before, '{START}') AS fen_before, q.fen AS fen_after, q.cp_loss, q.win_prob_after, q.quality,
       CAST(CASE WHEN m.rk <= 5 THEN m.rk ELSE 0 END AS INT) AS mistake_rank
FROM q JOIN s ON q.game_id = s.game_id LEFT JOIN games g ON q.game_id = g.game_id
LEFT JOIN m ON q.game_id = m.game_id AND q.ply = m.ply""", ("games", "plies"))

def _stored(fn):
    """A feature on games and plies that are stored by game (a bucket per task)."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        games, stored = plies.store(td.games(spark, sf_dir), td.plies(spark, sf_dir), fresh_path(spark, "by-game"), per_bucket=200_000)
        return fn(games, stored)
    return build


register("stored_eval_summary", _stored(lambda g, p: ev.eval_summary(p)), EVAL_CTE + """
SELECT game_id, COUNT(*) AS total_moves_analyzed,
       COUNT(*) FILTER (WHERE quality IN ('mistake', 'blunder')) AS mistakes,
       COUNT(*) FILTER (WHERE quality = 'blunder') AS blunders,
       ROUND_EVEN(AVG(cp_loss), 1) AS avg_cp_loss
FROM ev GROUP BY game_id""", ("plies",))

register("games_without_evals", _games_plies(ev.games_without_evals), """
SELECT game_id, white, black, 'evaluation unavailable' AS error
FROM games g WHERE NOT EXISTS (SELECT 1 FROM plies p WHERE p.game_id = g.game_id)""", ("games", "plies"))

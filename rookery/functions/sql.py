"""The library's expressions and analyses for SQL users.

``register_functions`` makes the column expressions of ``exprs`` functions of a
session, and ``register_analyses`` the report's analyses table functions over a view
of games. All bodies are SQL: the planner inlines them, so a call costs what the
expression costs, and no Python runs.

    SELECT time_class(time_control) AS class, count(*) FROM games_table GROUP BY ALL
    SELECT * FROM top_openings(10)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import exprs


def _cases(bounds, value: str) -> str:
    return " ".join(f"WHEN {value} < {bound} THEN '{label}'" for bound, label in bounds)


_BASE = "try_cast(split_part(tc, '+', 1) AS INT)"

#: name -> (parameters, result, body)
FUNCTIONS = {
    "nonempty": ("s STRING", "BOOLEAN", "s IS NOT NULL AND s <> ''"),
    "share_pct": ("num DOUBLE, den DOUBLE, digits INT", "DOUBLE", "CASE digits WHEN 0 THEN round(100.0D * num / den, 0) WHEN 1 THEN round(100.0D * num / den, 1) ELSE round(100.0D * num / den, 2) END"),
    "floor_bucket": ("x DOUBLE, width INT", "DOUBLE", "CAST(floor(x / CAST(width AS DOUBLE)) * width AS DOUBLE)"),
    "time_class": ("tc STRING", "STRING", f"""CASE WHEN contains(tc, '+') THEN CASE {_cases(exprs.TIME_CLASS_BOUNDS, _BASE)}
        WHEN {_BASE} IS NOT NULL THEN '{exprs.TIME_CLASS_ELSE}' ELSE '{exprs.TIME_CLASS_OTHER}' END
        WHEN tc = '-' THEN '{exprs.TIME_CLASS_CORRESPONDENCE}' ELSE '{exprs.TIME_CLASS_OTHER}' END"""),
    "effective_cp": ("cp INT, mate INT", "INT", f"coalesce(cp, CASE WHEN mate > 0 THEN {exprs.MATE_SCORE} WHEN mate IS NOT NULL THEN -{exprs.MATE_SCORE} END, 0)"),
    "win_probability": ("cp INT", "DOUBLE", f"CASE WHEN cp IS NULL THEN 0.5D ELSE bround(1.0D / (1.0D + exp(-cp / {exprs.WIN_PROB_SCALE}D)), 4) END"),
    "move_quality": ("signed_change INT, is_best BOOLEAN", "STRING", f"CASE {_cases(exprs.QUALITY_BOUNDS, 'signed_change')} WHEN is_best THEN 'good' ELSE 'ok' END"),
    "blame": ("color STRING, diff INT", "STRING", f"CASE WHEN color = 'black' AND diff > {exprs.BLAME_THRESHOLD} THEN 'black' WHEN color = 'white' AND diff < -{exprs.BLAME_THRESHOLD} THEN 'white' END"),
    "ply_color": ("ply INT", "STRING", "CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END"),
    "move_number": ("ply INT", "INT", "CAST(floor(ply / 2) + 1 AS INT)"),
    "position_key": ("fen STRING", "STRING", r"array_join(slice(split(trim(fen), '\\s+'), 1, 4), ' ')"),
    "word_count": ("s STRING", "INT", r"size(filter(split(s, '\\s+'), w -> w <> ''))"),
    "first_move": ("moves STRING", "STRING", "split_part(moves, ' ', 1)"),
}

_DECIDED = ", ".join(f"'{r}'" for r in exprs.RESULTS_DECIDED)
_WDL = ", ".join(f"share_pct(count_if(result = '{r}'), count(*), 1)" for r in exprs.RESULTS_DECIDED)
_SIDES = "(SELECT stack(2, 'white', white, white_elo, 'black', black, black_elo) AS (side, player, elo), white_elo, black_elo FROM {games})"


def _shares(key: str, kind: str, value: str, where: str) -> tuple[str, str, str]:
    # the total's filter is built-in: Spark does not rewrite SQL functions in a subquery of a table function
    body = f"""SELECT k, n, share_pct(n, (SELECT count(*) FROM {{games}} WHERE {where}), 2)
        FROM (SELECT {value} AS k, count(*) AS n FROM {{games}} WHERE {where} GROUP BY 1)"""
    return "", f"{key} {kind}, count BIGINT, pct DOUBLE", body


#: name -> (parameters, columns, body over {games})
ANALYSES = {
    "total_games": ("", "total_games BIGINT", "SELECT count(*) FROM {games}"),
    "results": _shares("result", "STRING", "result", f"result IN ({_DECIDED})"),
    "time_controls": _shares("time_class", "STRING", "time_class(time_control)", "time_control <> ''"),
    "eco_categories": _shares("eco_cat", "STRING", "left(eco, 1)", "eco <> ''"),
    "terminations": ("k INT DEFAULT 15", "termination STRING, count BIGINT, pct DOUBLE", """
        SELECT termination, n, share_pct(n, total, 2) FROM (
          SELECT termination, n, total, row_number() OVER (ORDER BY n DESC, termination) AS r FROM (
            SELECT termination, count(*) AS n, (SELECT count(*) FROM {games} WHERE termination <> '') AS total
            FROM {games} WHERE nonempty(termination) GROUP BY termination)) WHERE r <= terminations.k"""),
    "elo_histogram": ("width INT DEFAULT 100", "elo_bucket DOUBLE, count BIGINT", f"""
        SELECT floor_bucket(elo, elo_histogram.width), count(*) FROM {_SIDES} WHERE elo > 400 AND elo < 3500 GROUP BY 1"""),
    "elo_stats": ("", "avg_white DOUBLE, avg_black DOUBLE, median_white DOUBLE, median_black DOUBLE", """
        SELECT avg(white_elo), avg(black_elo), percentile(white_elo, 0.5), percentile(black_elo, 0.5)
        FROM {games} WHERE white_elo > 400 AND black_elo > 400"""),
    "top_openings": ("k INT DEFAULT 30", "eco STRING, opening STRING, count BIGINT, white_win_pct DOUBLE, black_win_pct DOUBLE, draw_pct DOUBLE", f"""
        SELECT eco, opening, n, w, b, d FROM (
          SELECT eco, opening, n, w, b, d, row_number() OVER (ORDER BY n DESC, eco, opening) AS r FROM (
            SELECT eco, opening, count(*) AS n, {_WDL} FROM {{games}} WHERE nonempty(eco) GROUP BY eco, opening) AS t(eco, opening, n, w, b, d))
        WHERE r <= top_openings.k"""),
    "move_count_dist": ("", "num_moves SMALLINT, count BIGINT", "SELECT num_moves, count(*) FROM {games} WHERE num_moves > 0 AND num_moves < 300 GROUP BY num_moves"),
    "daily_activity": ("", "date STRING, count BIGINT", f"SELECT date, count(*) FROM {{games}} WHERE nonempty(date) AND date <> '{exprs.UNKNOWN_DATE}' GROUP BY date"),
    "top_players": ("k INT DEFAULT 20", "player STRING, games BIGINT, peak_elo SMALLINT", f"""
        SELECT player, n, peak FROM (SELECT player, n, peak, row_number() OVER (ORDER BY n DESC, player) AS r FROM (
          SELECT player, count(*) AS n, max(elo) AS peak FROM {_SIDES} WHERE elo > 0 GROUP BY player)) WHERE r <= top_players.k"""),
    "rating_advantage": ("width INT DEFAULT 50", "elo_diff_bucket DOUBLE, count BIGINT, white_win_pct DOUBLE, black_win_pct DOUBLE, draw_pct DOUBLE", f"""
        SELECT floor_bucket(white_elo - black_elo, rating_advantage.width), count(*), {_WDL}
        FROM {{games}} WHERE white_elo > 400 AND black_elo > 400 AND abs(white_elo - black_elo) <= 500 GROUP BY 1"""),
}


def register_functions(spark: SparkSession) -> None:
    """The functions of ``FUNCTIONS``, temporary in the session."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_analyses(spark: SparkSession, games: str) -> None:
    """The table functions of ``ANALYSES`` over the view ``games``; results have no order."""
    register_functions(spark)
    for name, (parameters, columns, body) in ANALYSES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body.replace('{games}', games)}")

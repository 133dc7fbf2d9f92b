"""Queries in plain SQL over the session's functions and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import sql
from ..session import fresh_path
from ..sources import corpus, files
from ..sources import testdata as td
from .catalog import register
from .queries_evals import DIFF_CTE, EVAL_CTE
from .report_sql import CELLS, REPORT_SQL, cells_sql


def _games_view(spark: SparkSession, sf_dir: str) -> None:
    """A games table written by source, as the view ``games_table``, and the functions over it."""
    path = fresh_path(spark, "games-by-source")
    files.write_games(td.games(spark, sf_dir).withColumn("source", corpus.source_name("event")), path, ["source"])
    files.read_games(spark, path, "games_table")
    sql.register_analyses(spark, "games_table")


def _time_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    _games_view(spark, sf_dir)
    return spark.sql("""
        SELECT time_class(time_control) AS time_class, count(*) AS count,
               share_pct(count(*), (SELECT count(*) FROM games_table WHERE nonempty(time_control)), 2) AS pct
        FROM games_table WHERE nonempty(time_control) GROUP BY ALL""")


register("sql_functions", _time_controls, REPORT_SQL["time_controls"], ("games",))


def _move_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register_functions(spark)
    return spark.sql("""
        WITH e AS (SELECT *, effective_cp(cp, mate) AS eff FROM {plies}),
             d AS (SELECT *, ply_color(ply) AS color, lag(eff) OVER (PARTITION BY game_id ORDER BY ply) AS before FROM e)
        SELECT game_id, ply, move_number(ply) AS move_number, color, blame(color, eff - coalesce(before, eff)) AS blame,
               win_probability(coalesce(before, 0)) AS win_prob_before, win_probability(eff) AS win_prob_after,
               move_quality((eff - coalesce(before, 0)) * CASE color WHEN 'white' THEN 1 ELSE -1 END, coalesce(uci = best_uci, false)) AS quality,
               position_key(fen) AS position_key
        FROM d""", plies=td.plies(spark, sf_dir))


register("sql_move_functions", _move_functions, DIFF_CTE + EVAL_CTE + r"""
SELECT dd.game_id, dd.ply, dd.move_number, dd.color, dd.blame, ev.win_prob_before, ev.win_prob_after, ev.quality,
       array_to_string(list_slice(string_split_regex(trim(dd.fen), '\s+'), 1, 4), ' ') AS position_key
FROM dd JOIN ev ON dd.game_id = ev.game_id AND dd.ply = ev.ply""", ("plies",))


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table function, as the cells that ``report_all`` has."""
    _games_view(spark, sf_dir)
    parts = []
    for name in sql.ANALYSES:
        texts, numbers = CELLS[name]
        key = f"concat_ws('|', {', '.join(texts)})" if texts else f"CAST(CAST(CAST({numbers[0]} AS DOUBLE) AS BIGINT) AS STRING)"
        values = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in numbers)
        parts.append(f"SELECT '{name}' AS analysis, key, measure, value FROM (SELECT {key} AS key, stack({len(numbers)}, {values}) AS (measure, value) FROM {name}())")
    return spark.sql(" UNION ALL ".join(parts))


_NAMES = ", ".join(f"'{n}'" for n in sql.ANALYSES)
register("sql_analyses", _analyses, f"SELECT * FROM ({cells_sql(status=False)}) WHERE analysis IN ({_NAMES})", ("games",))

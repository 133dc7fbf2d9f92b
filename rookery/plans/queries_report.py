"""Report analyses D1-D17, D24 and the registry summary (2.J) as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import report
from ..sources import testdata as td
from .catalog import register
from .report_sql import REPORT_SQL, cells_sql


def _on_games(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(td.games(spark, sf_dir))
    return build


for _key, _fn in {
    "total_games": report.total_games,
    "results": report.results,
    "elo_histogram": report.elo_histogram,
    "elo_histogram_by_side": report.elo_histogram_by_side,
    "elo_stats": report.elo_stats,
    "top_openings": report.top_openings,
    "time_controls": report.time_controls,
    "move_count_dist": report.move_count_dist,
    "move_stats": report.move_stats,
    "daily_activity": report.daily_activity,
    "terminations": report.terminations,
    "top_players": report.top_players,
    "eco_categories": report.eco_categories,
    "rating_advantage": report.rating_advantage,
    "top_game": report.top_game,
    "focus_player": report.focus_player,
    "ply_distribution_player": report.ply_distribution_player,
    "collection_sizes": report.collection_sizes,
}.items():
    register(_key, _on_games(_fn), REPORT_SQL[_key], ("games",))


def _report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_cells(report.report_input(td.games(spark, sf_dir)))


# Every number of the full report, each analysis isolated.
register("report_all", _report_all, cells_sql(), ("games",))

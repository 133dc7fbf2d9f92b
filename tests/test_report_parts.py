"""The report from parts of sources: what it reads, and that it equals the report on all games."""

import os

from conftest import SF001

from rookery import convert_and_report
from rookery.operators import report, report_parts
from rookery.plans.verify import compare
from rookery.session import fresh_path
from rookery.sources import corpus, files
from rookery.sources import testdata as td


def _table(spark):
    path = fresh_path(spark, "t-games")
    files.write_games(td.games(spark, SF001).withColumn("source", corpus.source_name("event")), path, ["source"])
    return path


def _cells(df):
    return df.toPandas()


def test_merged_parts_equal_the_report_on_all_games(spark):
    path, parts = _table(spark), fresh_path(spark, "t-parts")
    games = files.read_games(spark, path)
    for sources in (["rated_game_0"], ["rated_game_1", "rated_game_2"], ["rated_game_1"], ["rated_game_3", "not there"]):
        report_parts.update(games, parts, sources)
    assert report_parts.known_sources(spark, parts) == {f"rated_game_{i}" for i in range(4)}
    got = report.report_cells(None, sources=report_parts.merged(spark, parts))
    assert compare(_cells(got), _cells(report.report_cells(report.report_input(games)))) == []


def test_only_the_new_source_is_read(spark):
    games = files.read_games(spark, _table(spark))
    plan = report_parts.source_counts(games.where(games.source.isin(["rated_game_2"])))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(source" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "clock_times" not in plan.split("ReadSchema:")[1]


def test_a_source_without_games_now_leaves_nothing(spark):
    path, parts = _table(spark), fresh_path(spark, "t-parts")
    games = files.read_games(spark, path)
    report_parts.update(games, parts, [f"rated_game_{i}" for i in range(4)])
    report_parts.update(games.where("source <> 'rated_game_1'"), parts, ["rated_game_1"])
    rest = report.report_input(games.where("source <> 'rated_game_1'"))
    got = report.report_cells(None, sources=report_parts.merged(spark, parts))
    assert compare(_cells(got), _cells(report.report_cells(rest))) == []


def test_report_of_no_games(spark):
    parts = fresh_path(spark, "t-parts")
    cells = {(r.analysis, r.measure): r.value for r in report.report_cells(None, sources=report_parts.merged(spark, parts)).collect()}
    assert cells["total_games", "total_games"] == 0
    assert all(v is None for (a, _), v in cells.items() if a in ("elo_stats", "move_stats"))


def test_results_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    report.report_cells(report.report_input(td.games(spark, SF001))).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_job_makes_up_for_missing_parts(spark, tmpdir_path):
    src, games, out = (os.path.join(tmpdir_path, d) for d in ("in", "games", "report"))
    os.makedirs(src)
    for name in ("a", "b"):
        with open(os.path.join(src, f"{name}.pgn"), "w", encoding="utf-8") as f:
            f.write('[Event "x"]\n[White "w"]\n\n1. e4 *\n\n' * 3)
    files.convert_folder(spark, src, games)      # a run that ended before the parts were written
    outcome, errors = convert_and_report.run(spark, src, games, out)
    assert errors == {} and {r.status for r in outcome.collect()} == {"skipped"}
    assert spark.read.json(f"{out}/total_games").first().total_games == 6

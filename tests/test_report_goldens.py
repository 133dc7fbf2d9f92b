"""The report over the five fixture games, with values worked out by hand."""

import os

import pytest

from pyspark.sql import functions as F

from rookery.operators import report
from rookery.sources import pgn

GAMES5 = os.path.join(os.path.dirname(__file__), "fixtures", "games5.pgn")


@pytest.fixture(scope="module")
def games(spark):
    return pgn.parse_games(pgn.scan_pgn(spark, GAMES5, glob=None)).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_results_and_total(games):
    assert rows(report.total_games(games)) == [(5,)]
    assert rows(report.results(games)) == [("0-1", 2, 40.0), ("1-0", 2, 40.0), ("1/2-1/2", 1, 20.0)]


def test_time_controls(games):
    assert sorted(rows(report.time_controls(games))) == [
        ("Blitz", 1, 25.0), ("Bullet", 1, 25.0), ("Classical", 1, 25.0), ("Rapid", 1, 25.0)]


def test_elo(games):
    assert rows(report.elo_histogram(games)) == [
        (1400.0, 1), (1500.0, 2), (1800.0, 1), (1900.0, 1), (2000.0, 1), (2200.0, 1), (2500.0, 1), (2600.0, 1)]
    assert rows(report.elo_stats(games)) == [(2078.75, 1976.25, 2102.5, 1897.5)]


def test_dates_terminations_eco(games):
    assert rows(report.daily_activity(games)) == [("2025.03.01", 1), ("2025.03.02", 1), ("2025.03.03", 2)]
    assert rows(report.terminations(games)) == [
        ("Normal", 3, 60.0), ("Draw by repetition", 1, 20.0), ("Time forfeit", 1, 20.0)]
    assert rows(report.eco_categories(games)) == [("B", 1, 25.0), ("C", 2, 50.0), ("D", 1, 25.0)]


def test_rating_advantage(games):
    assert rows(report.rating_advantage(games)) == [
        (-50.0, 1, 0.0, 100.0, 0.0), (0.0, 2, 50.0, 0.0, 50.0), (400.0, 1, 100.0, 0.0, 0.0)]


def test_moves(games):
    assert rows(report.move_stats(games)) == [(12.4, 11.0, 7, 20, 10.0, 14.0)]
    assert rows(report.move_count_dist(games)) == [(7, 1), (10, 1), (11, 1), (14, 1), (20, 1)]


def test_top_game_players(games):
    top = report.top_game(games).collect()[0]
    assert (top.game_id, top.white, top.black, top.total_elo) == (1, "AnnaTest", "BorisTest", 5200)
    assert rows(report.top_players(games))[0] == ("AnnaTest", 2, 2610)
    assert rows(report.focus_player(games)) == [("AnnaTest", 2)]


def test_registry_isolates_failures(games):
    results, errors = report.run_report(report.report_input(games))
    assert set(results) == set(report.REPORT) and errors == {}
    broken = games.drop("termination")   # one analysis cannot run on this input
    results, errors = report.run_report(broken)
    assert set(errors) == {"terminations"} and set(results) == set(report.REPORT) - {"terminations"}


def test_added_and_failing_analyses_are_seen(games, monkeypatch):
    monkeypatch.setitem(report.DIMENSIONS, "white", report.Dimension(lambda: {"white": F.col("white")}, lambda: F.lit(True)))
    monkeypatch.setitem(report.DIMENSIONS, "bad", report.Dimension(lambda: {"x": F.raise_error(F.lit("no")).cast("string")}, lambda: F.lit(True)))
    monkeypatch.setitem(report.REPORT, "whites", report.Analysis(lambda c: c.select("white", "count"), "white"))
    monkeypatch.setitem(report.REPORT, "own", report.Analysis(lambda g: g.agg(F.max("game_id").alias("last"))))
    monkeypatch.setitem(report.REPORT, "bad", report.Analysis(lambda c: c, "bad"))
    results, errors = report.run_report(games)
    assert set(errors) == {"bad"} and set(results) == set(report.REPORT) - {"bad"}
    assert sum(r["count"] for r in results["whites"].collect()) == 5 and results["own"].first().last == 5
    cells = report.report_cells(games).collect()
    assert {r.analysis for r in cells} == set(report.REPORT) and [r.analysis for r in cells if r.status == "error"] == ["bad"]


def test_shared_pass_equals_each_alone(games):
    from rookery.plans.verify import compare
    together, errors = report.run_report(games)
    alone, _ = report.run_report(games, shared=False)
    assert errors == {} and set(together) == set(alone) == set(report.REPORT)
    for name in report.REPORT:
        assert compare(together[name].toPandas(), alone[name].toPandas()) == [], name


def test_share_has_no_single_task_over_keys(spark):
    games = spark.createDataFrame([("Normal", "1-0"), ("Time", "0-1")], "termination string, result string")
    plan = report.terminations(games)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan

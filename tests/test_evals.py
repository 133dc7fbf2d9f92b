"""Evaluation features on games of any length, and the evaluation document."""

import pytest

from pyspark.sql import functions as F

from rookery.operators import evals
from rookery.sources import testdata as td
from conftest import SF001


@pytest.fixture(scope="module")
def plies(spark):
    """A game of 400 plies whose last ten have no score, and one of two plies."""
    long = spark.range(400).select(F.lit(1).alias("game_id"), F.col("id").cast("int").alias("ply"),
                                   F.when(F.col("id") < 390, (F.col("id") * 37 % 400 - 200).cast("int")).alias("cp"))
    short = spark.createDataFrame([(2, 0, 10), (2, 1, None)], "game_id int, ply int, cp int")
    both = long.unionByName(short)
    return both.select("*", F.when((F.col("game_id") == 2) & (F.col("ply") == 1), F.lit(-2)).alias("mate"), F.lit("e2e4").alias("uci"), F.lit("e4").alias("san"),
                       F.when(F.col("ply") % 2 == 0, F.lit("e2e4")).otherwise(F.lit("")).alias("best_uci"), F.lit("e4").alias("best_san"),
                       F.concat(F.lit("pos "), F.col("ply").cast("string")).alias("fen")).cache()


def test_no_ply_is_left_out(plies):
    assert evals.ply_evaluations(plies).count() == 402
    assert evals.eval_summary(plies).where("game_id = 1").first().total_moves_analyzed == 400
    assert evals.ply_evaluations(plies, max_plies=300).where("game_id = 1").count() == 300
    assert evals.ply_evaluations(plies).where("game_id = 1 and ply >= 300 and quality = 'blunder'").count() > 0


def test_evaluation_document(spark, plies):
    games = spark.createDataFrame([(1, "Ann", "Bob")], "game_id int, white string, black string")
    docs = {r.game_id: r for r in evals.evaluation_documents(games, plies).collect()}
    one, two = docs[1], docs[2]
    assert (one.white, one.black, two.white, two.black) == ("Ann", "Bob", "White", "Black")
    assert one.plies == len(one.evaluations) == 400 and [e.ply for e in one.evaluations] == list(range(400))
    assert one.evaluations[0].fen_before.startswith("rnbqkbnr") and one.evaluations[7].fen_before == "pos 6" and one.evaluations[7].fen_after == "pos 7"
    assert (one.evaluations[0].player, one.evaluations[1].player) == ("Ann", "Bob")
    # the tail without scores was not evaluated
    assert one.summary.total_moves_analyzed == 390 and all(e.quality is None for e in one.evaluations[390:])
    assert len(one.best_moves) == 200 and len(one.top_mistakes) == 5
    losses = sorted((-e.cp_loss, e.ply) for e in one.evaluations[:390] if e.quality in ("inaccuracy", "mistake", "blunder"))[:5]
    assert [(-m.cp_loss, m.ply) for m in one.top_mistakes] == losses
    # a mate counts against the side that allows it
    assert two.evaluations[1].eval_after == -10000 and two.summary.total_moves_analyzed == 2


def test_counts_and_last_positions_agree_with_documents(spark):
    games, plies = td.games(spark, SF001), td.plies(spark, SF001)
    docs = evals.game_documents(games, plies)
    for short, long in ((evals.ply_counts(plies), evals.document_ply_count(docs)), (evals.final_positions(plies), evals.final_position(docs))):
        assert short.exceptAll(long).count() == 0 and long.exceptAll(short).count() == 0


def test_counting_builds_no_documents(spark):
    plan = evals.ply_counts(td.plies(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan

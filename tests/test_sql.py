"""SQL functions against the column expressions that they stand for."""

from pyspark.sql import functions as F

from rookery.functions import exprs, sql
from rookery.plans.verify import compare


def test_functions_equal_the_expressions(spark):
    sql.register_functions(spark)
    rows = [("60+1", 10, None, "white", 90), ("59+0", None, 3, "black", 81), ("x+1", None, -2, "black", 80), ("-", None, None, "white", -81), ("", -150, None, "white", -80),
            ("1800+5", 250, 0, "black", None), (None, 0, None, None, 0), ("600+0", -201, None, "white", -500), ("179+2", -51, 0, "black", 100)]
    df = spark.createDataFrame([(*r, i, f"  r{i}/8  w KQkq -   0 1", "e2e4  e7e5 g1f3" if i % 2 else "") for i, r in enumerate(rows)],
                               "tc string, cp int, mate int, color string, diff int, ply int, fen string, moves string")
    df.createOrReplaceTempView("sql_rows")
    best = F.col("ply") % 2 == 0
    pairs = {
        "time_class(tc)": exprs.time_class("tc"), "effective_cp(cp, mate)": exprs.effective_cp("cp", "mate"), "win_probability(cp)": exprs.win_probability("cp"),
        "move_quality(cp, ply % 2 = 0)": exprs.move_quality("cp", best), "blame(color, diff)": exprs.blame("color", "diff"), "ply_color(ply)": exprs.ply_color("ply"),
        "move_number(ply)": exprs.move_number("ply"), "position_key(fen)": exprs.position_key("fen"), "word_count(moves)": exprs.word_count("moves"),
        "floor_bucket(cp, 50)": exprs.bucket("cp", 50), "nonempty(tc)": exprs.nonempty("tc"), "share_pct(ply, 7, 1)": exprs.pct("ply", F.lit(7), 1),
        "first_move(moves)": F.split_part("moves", F.lit(" "), F.lit(1))}
    got = spark.sql(f"SELECT ply, {', '.join(f'{call} AS c{i}' for i, call in enumerate(pairs))} FROM sql_rows")
    want = df.select("ply", *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())])
    assert compare(got.toPandas(), want.toPandas()) == []
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_parameters_of_table_functions(spark):
    games = spark.createDataFrame([(f"p{i % 7}", f"q{i % 3}", 1500 + 7 * i, 1600 + i, "1-0", "A0" + str(i % 4), "x") for i in range(50)],
                                  "white string, black string, white_elo int, black_elo int, result string, eco string, opening string")
    games = games.select("*", *[F.lit("").alias(c) for c in ("time_control", "termination", "date", "moves_uci")], F.lit(3).cast("smallint").alias("num_moves"))
    games.createOrReplaceTempView("few_games")
    sql.register_analyses(spark, "few_games")
    assert spark.sql("SELECT * FROM top_players(2)").count() == 2
    assert spark.sql("SELECT * FROM top_openings()").count() == 4
    assert [r[0] for r in spark.sql("SELECT player FROM top_players(k => 1)").collect()] == ["q0"]
    assert spark.sql("SELECT sum(count) FROM elo_histogram(25)").first()[0] == 100

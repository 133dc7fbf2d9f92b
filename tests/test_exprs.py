"""Scalar expressions on edge cases."""


from rookery.functions import exprs


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_time_class_edges(spark):
    got = one(spark, exprs.time_class("tc"), "tc string",
              [("59+0",), ("60+1",), ("179+2",), ("180+0",), ("599+5",), ("600+0",), ("1799+0",), ("1800+0",),
               ("-",), ("600",), ("1/86400",), ("180.5+2",), ("abc+1",)])
    assert got == ["UltraBullet", "Bullet", "Bullet", "Blitz", "Blitz", "Rapid", "Rapid", "Classical",
                   "Correspondence", "Other", "Other", "Other", "Other"]


def test_effective_cp_and_win_probability(spark):
    rows = [(35, None), (None, 3), (None, -1), (None, 0), (None, None)]
    assert one(spark, exprs.effective_cp("cp", "mate"), "cp int, mate int", rows) == [35, 10000, -10000, -10000, 0]
    wp = one(spark, exprs.win_probability("cp"), "cp int", [(0,), (400,), (None,), (-10000,)])
    assert wp == [0.5, 0.7311, 0.5, 0.0]


def test_quality_blame_and_keys(spark):
    q = one(spark, exprs.move_quality("d", "best"), "d int, best boolean",
            [(-201, False), (-200, False), (-101, True), (-51, False), (-50, True), (10, False)])
    assert q == ["blunder", "mistake", "mistake", "inaccuracy", "good", "ok"]
    b = one(spark, exprs.blame("c", "d"), "c string, d int",
            [("black", 81), ("black", 80), ("white", -81), ("white", 200), ("black", -500)])
    assert b == ["black", None, "white", None, None]
    k = one(spark, exprs.position_key("f"), "f string", [("  8/8/8/8/8/8/8/K6k w - - 12 40 ",)])
    assert k == ["8/8/8/8/8/8/8/K6k w - -"]
    assert one(spark, exprs.word_count("t"), "t string", [("  a  b\tc\n",), ("",)]) == [3, 0]
    assert one(spark, exprs.bucket("x", 50), "x int", [(-20,), (49,), (50,)]) == [-50.0, 0.0, 50.0]

"""Skew-safe ranks and serial allocation against plain Python on a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.operators import naming
from rookery.operators.skew import rank_within, running_sum


def test_rank_within_hot_key(spark):
    rows = [(("hot" if i % 3 else f"k{i % 7}"), i * 7 + 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, id long")
    got = {(r.key, r.id): r.rank for r in rank_within(df, ["key"], "id", width=50).collect()}
    want = {(r.key, r.id): r.rn for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).collect()}
    assert got == want


def test_running_sum_exclusive(spark):
    df = spark.createDataFrame([("a", i, i % 4) for i in range(200)], "key string, o long, v long")
    got = {r.o: r.s for r in running_sum(df, ["key"], "o", "v", width=16, out="s", inclusive=False).collect()}
    acc, want = 0, {}
    for i in range(200):
        want[i] = acc
        acc += i % 4
    assert got == want


def allocate_py(new, used):
    out = {}
    taken = {}
    for base, s in used:
        taken.setdefault(base, set()).add(s)
    for gid, base in sorted(new):
        s = 1
        while s in taken.setdefault(base, set()):
            s += 1
        taken[base].add(s)
        out[gid] = f"{base}_{s:04d}"
    return out


def test_allocate_stems_fills_gaps(spark):
    new = [(i, "A_vs_B_XX" if i % 2 else f"C{i % 5}_vs_D_E1") for i in range(1, 400)]
    used = [("A_vs_B_XX", s) for s in (2, 3, 7, 8, 9, 40)] + [("C1_vs_D_E1", 1)]
    got = {r.game_id: r.stem for r in naming.allocate_stems(
        spark.createDataFrame(new, "game_id int, base string"),
        spark.createDataFrame(used, "base string, serial long")).collect()}
    assert got == allocate_py(new, used)


def test_sanitize(spark):
    df = spark.createDataFrame([("Kasparov, Garry", "Topalov  Veselin", "B07"), ("", "__x__", "?"),
                                ("Łukasz Ż", "Ådne", "")], "w string, b string, e string")
    got = [r[0] for r in df.select(naming.stem_base("w", "b", "e")).collect()]
    assert got == ["Kasparov_Garry_vs_Topalov_Veselin_B07", "Unknown_vs_x_XX", "Łukasz_Ż_vs_Ådne_XX"]


def test_null_keys_are_keys(spark):
    rows = [(None, 1), ("a", 2), (None, 3), ("a", 70000)]
    df = spark.createDataFrame(rows, "key string, id long")
    got = sorted((str(r.key), r.id, r["rank"]) for r in rank_within(df, ["key"], "id").collect())
    assert got == [("None", 1, 1), ("None", 3, 2), ("a", 2, 1), ("a", 70000, 2)]

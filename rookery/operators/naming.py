"""Output names for narrated games (H26) and their serial numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import rank_within, running_sum

# Fixed values
UNKNOWN_NAME = "Unknown"
UNKNOWN_ECO = "XX"
SERIAL_DIGITS = 4


def sanitize_name(name: Column | str) -> Column:
    """Non-word characters (Unicode-aware) -> '_', runs squeezed, ends trimmed."""
    c = F.col(name) if isinstance(name, str) else name
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w]", "_")
    x = F.regexp_replace(x, "_+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(x == "", F.lit(UNKNOWN_NAME)).otherwise(x)


def eco_token(eco: Column | str) -> Column:
    c = F.col(eco) if isinstance(eco, str) else eco
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w]", "")
    return F.when(x == "", F.lit(UNKNOWN_ECO)).otherwise(x)


def stem_base(white="white", black="black", eco="eco") -> Column:
    return F.concat(sanitize_name(white), F.lit("_vs_"), sanitize_name(black), F.lit("_"), eco_token(eco))


def serial_text(n: Column) -> Column:
    return F.when(n < 10 ** SERIAL_DIGITS, F.lpad(n.cast("string"), SERIAL_DIGITS, "0")).otherwise(n.cast("string"))


def allocate_stems(new: DataFrame, used: DataFrame, id_col: str = "game_id") -> DataFrame:
    """Give every new item the next free serial of its ``base``, filling
    gaps among the ``used`` serials first, in ``id_col`` order.

    With used serials u_1 < u_2 < ... and g_j = u_j - j (free numbers below
    u_j), the k-th free serial is k + #{j : g_j < k}. Ranks and that count are
    skew-safe running sums, so a base with a third of all items is split over
    many tasks. ``new``: (id_col, base); ``used``: (base, serial)."""
    ranked = rank_within(new.select(id_col, "base"), ["base"], id_col, out="k")
    u = used.where(F.col("serial") >= 1).select("base", "serial").distinct()
    u = rank_within(u, ["base"], "serial", out="j").select("base", (F.col("serial") - F.col("j")).alias("g"))
    gaps = u.groupBy("base", "g").agg(F.count(F.lit(1)).alias("c"))
    rows = (ranked.select("base", F.col(id_col).alias("_id"), F.col("k").alias("value"),
                          (F.col("k") * 2).alias("_o"), F.lit(0).cast("long").alias("c"))
            .unionByName(gaps.select("base", F.lit(None).cast(new.schema[id_col].dataType).alias("_id"),
                                     F.col("g").alias("value"), (F.col("g") * 2 + 1).alias("_o"), "c")))
    counted = running_sum(rows, ["base"], "_o", "c", out="_below")
    serial = F.col("value") + F.col("_below")
    return (counted.where(F.col("_id").isNotNull())
            .select(F.col("_id").alias(id_col), F.concat(F.col("base"), F.lit("_"), serial_text(serial)).alias("stem")))

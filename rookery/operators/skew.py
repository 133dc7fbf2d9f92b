"""Per-key running counts that stay exact when one key holds a third of the rows.

A plain ``row_number() over (partition by key order by x)`` sends every row of
a key to one task. Here the order column (an integer) is cut into fixed-width
buckets: the window runs per (key, bucket), which holds at most ``width`` rows
when the order values are unique, and a small table of per-bucket totals gives
each bucket its offset within the key. The result equals the plain window.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def _bucket(order_col: str, width: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(width)).cast("long")


def running_sum(df: DataFrame, keys: list[str], order_col: str, value: str | None = None,
                width: int = DEFAULT_WIDTH, out: str = "running", inclusive: bool = True) -> DataFrame:
    """Adds ``out`` = sum of ``value`` (1 when None) over the rows of the same
    ``keys`` with a smaller ``order_col`` (plus the row itself when
    ``inclusive``); ties in ``order_col`` are broken by the row order Spark
    sees, so give unique order values for a deterministic result."""
    v = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    b = df.withColumn("_b", _bucket(order_col, width)).withColumn("_v", v)
    frame = Window.partitionBy(*keys, "_b").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    b = b.withColumn("_in", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    totals = b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    # a NULL key or order value is a key like any other
    offsets = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*keys, "_b"])], "_off")
    same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate([*keys, "_b"])]
    return (b.join(offsets, reduce(and_, same))
            .withColumn(out, F.col("_off") + F.col("_in"))
            .drop("_b", "_v", "_in", "_off", *[f"_o{i}" for i in range(len(keys) + 1)]))


def rank_within(df: DataFrame, keys: list[str], order_col: str, width: int = DEFAULT_WIDTH,
                out: str = "rank") -> DataFrame:
    """Exact 1-based ``row_number`` within ``keys`` by a unique integer ``order_col``."""
    return running_sum(df, keys, order_col, None, width, out)

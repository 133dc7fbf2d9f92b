"""Helpers shared by the operators: table paths and written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never the
    operators in front of this table, and what follows sees fixed rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out


def splits_of(df: DataFrame) -> int:
    """How many tasks read ``df``: a measure of its size that grows with it."""
    return max(1, df.rdd.getNumPartitions())


#: Parts that a group's rows are ranked in before they are ranked together.
RANK_PARTS = 64


def first_rows(df: DataFrame, key: str, order: list[Column], n: int, deal: Column, place: str) -> DataFrame:
    """The first ``n`` rows of every ``key`` in ``order``, with their ``place`` from 1.

    Rows are ranked within ``RANK_PARTS`` parts of a key first, dealt by the long
    ``deal``; what is ranked together then is bounded, however many rows a key has."""
    part = Window.partitionBy(key, "_part").orderBy(*order)
    few = (df.withColumn("_part", F.pmod(deal, F.lit(RANK_PARTS))).withColumn(place, F.row_number().over(part))
           .where(F.col(place) <= n).drop("_part", place))
    return few.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) <= n)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Python tasks that are planned inside are handed batches of ``size`` bytes at most
    (and one row more), instead of as many rows as the session allows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)

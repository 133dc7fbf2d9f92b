"""Spark session settings and the shared working folder.

Every job here runs on whatever session the caller hands in. ``build_session``
exists for tests, the bench and command-line use; library functions only read
settings from the session they are given.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. All are runtime SQL settings, so they can also be
# applied to a session somebody else built (``apply_conf``).
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "rookery",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # A local session must not depend on the host name resolving.
            builder = (builder.config("spark.driver.host", "127.0.0.1")
                       .config("spark.driver.bindAddress", "127.0.0.1"))
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    return spark


def _is_local(spark: SparkSession) -> bool:
    # one process; "local-cluster" has executors of its own
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Only a local session (tests, bench) without the
    setting gets a fresh folder of its own; a cluster session without it is an
    error, because a machine-local folder is not visible to the executors.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset
            root = None
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="rookery-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder, for tables and files a job writes."""
    return "/".join([checkpoint_root(spark), "rookery", *parts])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A not yet used path below the shared folder."""
    return work_path(spark, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, and
    what follows sees its size and fixed rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, path: str, sort: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table at ``path``, bucketed by ``key`` and sorted within its files, so
    that joins, windows and aggregates on the key do not move its rows. The catalog's
    entry goes at once; the files stay."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    w = df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd")
    (w.sortBy(*sort) if sort else w).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved, with its files, before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_scratch(spark: SparkSession) -> None:
    """Delete what jobs have left below ``scratch/``, once nothing reads it any more."""
    delete_paths(spark, [work_path(spark, "scratch")])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system, so it works for any scheme."""
    fs, jpath = file_system(spark, path)
    return bool(fs.exists(jpath))


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder."""
    fs, jpath = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)]


def escaped_name(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in the name of its folder."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def unescaped_name(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders, through the Hadoop file system."""
    for path in paths:
        fs, jpath = file_system(spark, path)
        fs.delete(jpath, True)

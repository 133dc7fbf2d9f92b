"""State of a stream as a table per micro-batch.

A batch reads the state that the batch before it has left and writes its own,
whole. So a batch that is run again starts from the same state and replaces its own
output, and what a batch costs depends on the state, not on the number of batches.
States older than the one before the last are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import child_names, delete_paths, path_exists


class Snapshots:
    """The states below ``folder``, with the columns of ``schema``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _batches(self) -> list[int]:
        if not path_exists(self.spark, self.folder):
            return []
        batches = sorted(int(n[len("batch="):]) for n in child_names(self.spark, self.folder) if n.startswith("batch="))
        return [b for b in batches if path_exists(self.spark, f"{self.folder}/batch={b}/_SUCCESS")]

    def before(self, batch_id: int | None = None) -> DataFrame:
        """The state that batch ``batch_id`` starts from, or the newest one; empty at first."""
        done = [b for b in self._batches() if batch_id is None or b < batch_id]
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={done[-1]}")

    def write(self, state: DataFrame, batch_id: int) -> DataFrame:
        """Write the state after batch ``batch_id``; the one before it stays for a repetition."""
        state.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        old = [b for b in self._batches() if b < batch_id][:-1]
        delete_paths(self.spark, [f"{self.folder}/batch={b}" for b in old])
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={batch_id}")

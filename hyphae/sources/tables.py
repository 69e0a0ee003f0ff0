"""Keyed tables in versioned Parquet folders.

A change writes a whole new version beside the old one, and a version counts
once Spark has committed it, so a reader never sees half a change and a lost
task or driver leaves the version before in place. Old versions are kept for
readers under way, as many as `keep`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyphae.session import drop_path

DOCUMENTS = "id string, text string, metadata string, created_at timestamp, updated_at timestamp, seq long"
VECTORS = "id string, embedding array<double>, metadata string, seq long"
NODES = "id string, label string, node_type string, properties string, seq long"
EDGES = "id string, source_id string, target_id string, relation_type string, confidence double, evidence_text string, properties string, seq long"


class Table:
    """A table whose rows are replaced by key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, *, key: str = "id", keep: int = 2):
        self.spark, self.folder, self.schema, self.key, self.keep = spark, folder.rstrip("/"), schema, key, keep

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")))

    def frame(self) -> DataFrame:
        """The rows of the latest version."""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.spark.createDataFrame([], self.schema).schema).parquet(f"{self.folder}/v{found[-1]:08d}")

    def replace(self, rows: DataFrame) -> None:
        """Make these rows the new version."""
        found = self._versions()
        names = self.spark.createDataFrame([], self.schema).columns
        now = (found[-1] if found else 0) + 1
        rows.select(*names).write.mode("overwrite").parquet(f"{self.folder}/v{now:08d}")
        for old in found[: max(0, len(found) + 1 - self.keep)]:
            drop_path(self.spark, f"{self.folder}/v{old:08d}")

    def put(self, rows: DataFrame) -> None:
        """Insert or replace whole rows; of several with one key the one of highest seq."""
        latest = Window.partitionBy(self.key).orderBy(F.desc("seq"))
        once = rows.where(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        self.replace(self.frame().join(once.select(self.key), self.key, "left_anti").unionByName(once, allowMissingColumns=True))

    def change(self, rows: DataFrame) -> int:
        """Replace rows whose key is there; how many were."""
        known = rows.join(self.frame().select(self.key), self.key, "left_semi")
        n = known.select(self.key).distinct().count()
        if n:
            self.put(known)
        return n

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of these keys; how many were there."""
        gone = keys.select(self.key).distinct()
        n = self.frame().join(gone, self.key, "left_semi").count()
        if n:
            self.replace(self.frame().join(gone, self.key, "left_anti"))
        return n

    def get(self, key: str) -> dict | None:
        """The row of a key; the filter reaches the Parquet scan."""
        row = self.frame().where(F.col(self.key) == key).first()
        return row.asDict(recursive=True) if row else None

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """Rows in stored order."""
        return self.frame().orderBy("seq", self.key).offset(offset).limit(limit)

    def count(self) -> int:
        return self.frame().count()

"""What is new or has moved on at each run over a feed of deliveries.

A ChangeLog keeps, in the shared folder, the state of every id as of its last
run, in PARTITIONS partitions of a hash of the id, and for each partition a
fingerprint of the deliveries it was made from: their number and the sum of
their hashes. A run takes the fingerprints of what it sees, recomputes only the
partitions whose fingerprint has changed, and replaces each of them by dynamic
partition overwrite.

Order makes a run safe: first the changes of the run are written, then its
partitions, and last its fingerprints, which make it count. A run that dies on
the way is run again; what it had written before is found by its mark or
written over with the same rows, so nothing is skipped or repeated.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyphae.session import drop_path, fresh_path, written

PARTITIONS = 32


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def deliveries(feed: DataFrame) -> DataFrame:
    """(part, id, state, landed): a delivery without updated_at has the time of created_at, without either it is older than any."""
    state = F.coalesce(_micros("updated_at"), _micros("created_at"), F.lit(-(1 << 63)).cast("long"))
    rows = feed.select("id", state.alias("state"), _micros("landed_at").alias("landed")).where("id is not null and landed is not null")
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(PARTITIONS)).cast("int").alias("part"), "id", "state", "landed")


def fingerprints(seen: DataFrame) -> dict[int, tuple[int, int]]:
    """Number of deliveries and the sum of their hashes for each partition; at most PARTITIONS rows reach the driver."""
    rows = seen.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "state", "landed").cast("decimal(38,0)")).alias("h")).collect()
    return {r["part"]: (r["n"], int(r["h"])) for r in rows}


class ChangeLog:
    """States, fingerprints and changes of the runs so far, under one folder."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", run_type: str = "int"):
        self.spark, self.folder, self.id_type, self.run_type = spark, folder.rstrip("/"), id_type, run_type

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read_mark(self, name: str):
        fs, at = self._fs(name)
        if not fs.exists(at):
            return None
        return json.loads(self.spark.read.text(str(at.toString()), wholetext=True).first()[0])

    def _write_mark(self, name: str, value) -> None:
        """Write beside, then rename: the mark is there as a whole or not at all."""
        fs, at = self._fs(name)
        _, beside = self._fs(f"_{name}.new")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"{name} could not be put in place")

    def _overwrite(self, rows: DataFrame, name: str, by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.folder}/{name}")

    def _states(self) -> DataFrame:
        fs, at = self._fs("states")
        schema = f"id {self.id_type}, state long, part int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/states") if fs.exists(at) else self.spark.createDataFrame([], schema)

    def changes(self) -> DataFrame:
        """(run_no, id) of all runs so far."""
        fs, at = self._fs("changes")
        schema = f"id {self.id_type}, run_no {self.run_type}"
        found = self.spark.read.schema(schema).parquet(f"{self.folder}/changes") if fs.exists(at) else self.spark.createDataFrame([], schema)
        return found.select("run_no", "id")

    def _known(self) -> tuple[int | None, dict[int, tuple[int, int]]]:
        mark = self._read_mark("fingerprints") or self._read_mark("_fingerprints.new") or {"run": None, "parts": {}}
        return mark["run"], {int(k): tuple(v) for k, v in mark["parts"].items()}

    def run(self, run_no: int, seen: DataFrame, prints: dict[int, tuple[int, int]] | None = None) -> list[int]:
        """Make one run over the deliveries it sees; the partitions that were recomputed.

        `prints` are the fingerprints of `seen` if they are known already. A run
        that has been made does nothing when it is asked for again.
        """
        last, before = self._known()
        if last == run_no:
            return []
        now = fingerprints(seen) if prints is None else prints
        moved = sorted(p for p in now if now[p] != before.get(p))
        if moved:
            fresh = seen.where(F.col("part").isin(moved)).groupBy("part", "id").agg(F.max("state").alias("state"))
            if self._read_mark("changed") != run_no:
                was = self._states().where(F.col("part").isin(moved)).select("id", F.col("state").alias("was"))
                new = fresh.join(was, "id", "left").where("was is null or state > was")
                self._overwrite(new.select("id", F.lit(run_no).cast(self.run_type).alias("run_no")), "changes", "run_no")
                self._write_mark("changed", run_no)
            self._overwrite(fresh.select("id", "state", "part").repartition("part"), "states", "part")
        self._write_mark("fingerprints", {"run": run_no, "parts": now})
        return moved


def changed_per_run(feed: DataFrame, runs: DataFrame, *, status: str = "ok") -> DataFrame:
    """(run_no, id): ids that a counting run sees as new or later than the counting run before it.

    A run counts if its status is `status`; it sees the deliveries that have
    landed when it starts. All counting runs are made one after the other
    through a ChangeLog in the shared folder. Deliveries without id or
    landed_at are never seen; other columns are ignored. The feed is read once
    and laid down by partition; since counts and sums of hashes add up, the
    fingerprints of all runs come from one pass over it. Runs are collected, a
    row for each run of the store. The work is done when this is called; the
    folder of changes is what the result reads.
    """
    spark = feed.sparkSession
    counting = sorted((r["at"], r["run_no"]) for r in runs.where(F.col("status") == status).select(_micros("started_at").alias("at"), "run_no").where("at is not null and run_no is not null").distinct().collect())
    id_type, run_type = feed.schema["id"].dataType.simpleString(), runs.schema["run_no"].dataType.simpleString()
    log = ChangeLog(spark, fresh_path(spark, "changes"), id_type, run_type)
    if not counting:
        return log.changes()
    started = F.lit([at for at, _ in counting]).cast("array<long>")
    # the first run that sees a delivery, by the number of runs that started before it landed
    first = F.size(F.filter(started, lambda at: at < F.col("landed")))
    once = deliveries(feed).withColumn("first", first).where(F.col("first") < len(counting)).groupBy("part", "id", "first").agg(F.max("state").alias("state"), F.count("*").alias("n"), F.sum(F.xxhash64("id", "state", "landed").cast("decimal(38,0)")).alias("h"))
    laid, path = written(once.repartition("part"), "changes-feed")
    sums = laid.groupBy("part", "first").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).collect()  # PARTITIONS rows a run
    total: dict[int, tuple[int, int]] = {}
    for k, (_, run_no) in enumerate(counting):
        for r in sums:
            if r["first"] == k:
                n, h = total.get(r["part"], (0, 0))
                total[r["part"]] = (n + r["n"], h + int(r["h"]))
        log.run(run_no, laid.where(F.col("first") <= k), dict(total))
    drop_path(spark, path)
    return log.changes()

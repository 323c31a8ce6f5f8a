"""Snapshots as a stream of files: each micro-batch is reconciled with the last state.

An extension of the batch operators, for deliveries that keep coming. The state is a
table in the folder ``state``, one version per batch; a batch that is replayed after a
failure overwrites its own version, so results are exactly once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carryover.operators.reconcile import three_way


def _before(spark: SparkSession, state: str, batch: int) -> DataFrame | None:
    """The newest version before ``batch``; versions are listed through the file system of the session."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = (s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    versions = [int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n)) and int(m[1]) < batch]
    return spark.read.parquet(f"{state}/version={max(versions)}") if versions else None


def follow_snapshots(stream: DataFrame, key: str, digest: str, state: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Writes (key, change, batch) of each batch to ``changes`` and the new state to ``state``.

    Each batch is a whole snapshot; null keys are left out; a key delivered twice in a
    batch counts once, with its greatest digest.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(digest).alias(digest))
        before = _before(spark, state, number)
        now.write.mode("overwrite").parquet(f"{state}/version={number}")
        now = spark.read.parquet(f"{state}/version={number}")
        old = before if before is not None else now.limit(0)
        outcome = three_way(old, now, old, key, digest)
        change = F.when(F.col("outcome") == "new", "added").when(F.col("outcome") == "source_missing", "removed").when(F.col("outcome") == "source_changed", "changed")
        outcome.select(key, change.alias("change"), F.lit(number).alias("batch")).where("change IS NOT NULL").write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

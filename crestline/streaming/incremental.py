"""Long scans in slices: what is committed stays, and a later run does the rest."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators.summary import numbered
from crestline.sources.results import remaining, there

Scan = Callable[[DataFrame], DataFrame]


def in_slices(targets: DataFrame, scan: Scan, path: str, slice_size: int = 100_000, keys: tuple[str, ...] = ("target_id",), seconds: float | None = None, told: Callable[[int, int, float], None] | None = None) -> DataFrame:
    """Scans slice_size targets after the other, in target_id's order, and appends each to a Parquet table; finished targets are skipped.

    An interrupted slice leaves nothing, by the writer's commit, and is done again by the next call. With seconds, the
    slices after the first are as long as makes a commit about so often, at the rate so far, at least a tenth of
    and at most ten times the one before. told is called after each commit with targets done, targets in all and
    seconds so far.
    """
    spark = targets.sparkSession
    done = _held(spark, path)
    left = remaining(targets, done, *keys) if done is not None else targets
    placed = numbered(left, "target_id")
    total, at, size, began = left.count(), 0, slice_size, time.perf_counter()
    while at < total:
        started = time.perf_counter()
        part = placed.where(F.col("place").between(at, at + size - 1)).drop("place")
        scan(part).write.mode("append").parquet(path)
        at = min(total, at + size)
        now = time.perf_counter()
        if seconds:
            size = max(1, size // 10, min(10 * size, int(size * seconds / max(1e-3, now - started))))
        if told:
            told(at, total, now - began)
    return spark.read.parquet(path) if _held(spark, path) is not None else scan(left)


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, if there is one."""
    return spark.read.parquet(path) if there(spark, path) else None


def stream_targets(spark: SparkSession, source: str, schema: str, scan: Scan, path: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Scans target files as they are there, a batch of files at a time, and ends when all are done.

    The stream's checkpoint remembers finished files; a batch that is retried writes its own folder anew, so results
    aren't doubled.
    """

    def batch(targets: DataFrame, number: int) -> None:
        scan(targets).write.mode("overwrite").parquet(f"{path}/batch={number}")

    held = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    held.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

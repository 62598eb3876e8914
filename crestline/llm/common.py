"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.session import shared_dir, ship

#: Bounds of one Arrow batch, so that a task's Python memory doesn't follow the number of rows.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Just these columns, cast to these types. Others go, even if their names differ by case alone."""
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [name for name in columns if name not in at]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{at[name]}").cast(kind).alias(name) for name, kind in columns.items()))


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers, by rows and bytes, and sends them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Intermediate tables by application, until removed.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crestline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Removes this application's intermediate tables, once their results are written; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


#: Words whose hashes a worker keeps.
WORDS = 200_000


class Words(dict):
    """64-bit hashes of words, some of which are kept."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    x = x ^ (x >> u(33))
    x = x * u(0xFF51AFD7ED558CCD)
    x ^= x >> u(33)
    x = x * u(0xC4CEB9FE1A85EC53)
    x ^= x >> u(33)
    return x


def bitmap(rows: DataFrame, place: Column, n_bits: int) -> bytes:
    """n_bits bits, of which those at the rows' places (from 0) are set; put together on executors, n_bits / 8 bytes on the driver."""
    held = rows.select((place + 1).alias("k"))  # positions count from 1
    maps = held.groupBy(F.bitmap_bucket_number("k").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))
    bits = bytearray(n_bits // 8 + (1 << 12))
    for bucket, some in maps.toLocalIterator():  # a bounded number of bounded bitmaps
        at = (bucket - 1) * len(some)
        bits[at : at + len(some)] = bytes(some)
    return bytes(bits)


def remainder(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % F.lit(n)


def tidied(run, *kept):
    """run for mapInArrow, after which the task's worker forgets what it kept and gives unused memory back.

    Workers are reused: what one stage leaves in them would add to the next one's memory.
    """

    def task(batches):
        yield from run(batches)
        for make in kept:
            make().forget()
        give_back()

    return task


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries don't have it
        ctypes.CDLL(None).malloc_trim(0)


def binary_text(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a batch's strings; null is empty."""
    import pyarrow as pa

    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]

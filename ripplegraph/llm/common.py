"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that a Python task turns to strings at once; one longer text is a slice of its own.
SLICE = 2_000_000


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of its column number at, and of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give freed memory back to the system, as a worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session has none (tests, a laptop) a local temporary folder
    is set instead.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="ripplegraph-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        system, at = _folder(df.sparkSession, path)
        system.delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage
    is cut and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ripplegraph/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def tasks(spark: SparkSession) -> int:
    """How many tasks to deal work out to: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text modulo a number; null stays null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most so many bytes in all may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one is made and set, in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        old = sc._jsc.sc().getCheckpointDir()
        found = old.get() if old.isDefined() else tempfile.mkdtemp(prefix="docbraid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: lineage ends there.

    The table outlives any executor and is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docbraid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def fits(table: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table may be broadcast; rows of unlike sizes have theirs summed, not guessed."""
    size = table.count() * row_bytes if isinstance(row_bytes, int) else table.agg(F.sum(row_bytes)).first()[0] or 0
    return size <= limit


def checked_broadcast(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, materialised, with a broadcast hint only if its counted size is under the limit.

    Beyond the limit Spark joins it by shuffle like any other table.
    """
    table = materialise(df)
    return F.broadcast(table) if fits(table, row_bytes, limit) else table


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """128 bits that stand for (id, text); null and empty text differ."""
    mark = F.when(text_col.isNull(), F.lit(1)).otherwise(F.lit(0))
    return [F.xxhash64(id_col, text_col, mark), F.xxhash64(F.lit(7919), mark, text_col, id_col)]


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives memory that numpy and Arrow have freed back to the system: workers live as long as the executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(array: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 8192) -> Iterator[pa.Array]:
    """Consecutive parts of a string array of bounded size; a longer text is a part of its own."""
    if not len(array):
        return
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(array):
        end = int(np.searchsorted(total, total[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + most_rows, len(array))
        yield array.slice(at, end - at)
        at = end
    release()


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

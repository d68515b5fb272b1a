"""What the operators of this subpackage share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these white space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a file of a small table may have, about.
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session names it in
    spark.checkpoint.dir. Only a session whose executors are threads of the driver (local[...])
    may go without; it gets a folder beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not the work before, and statistics are exact.

    Where at most so many (narrow) rows are known to come, they are dealt to no more files than
    these call for, after all other work on them.
    """
    if rows is not None and 1 + rows // FILE_ROWS < partitions(df.sparkSession):
        df = df.repartition(1 + rows // FILE_ROWS)
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column | str) -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def repeated(df: DataFrame, times: Column, out: str, step: int = 1000) -> DataFrame:
    """Each row of df as often as times (long) says, numbered from 0 in column out; no long array is made."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), times - 1, F.lit(step).cast("long")))
    rest = F.explode(F.sequence(F.col(out), F.least(F.col(out) + step, times) - 1))
    return df.withColumn(out, first).withColumn(out, rest)


def release() -> None:
    """Give back to the system what this process has freed. Python workers live on from task to task,
    side by side in an executor's memory, and the allocators keep what big arrays have left."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a library of another system has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20, rows: int = 20_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and, but for single long texts, bytes of text.

    Only a slice is ever turned into Python objects, so a task's memory follows the slice and not
    the batch, however long its texts are.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = int(ends[begin - 1]) if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end

"""The block store: windows of tokens as Parquet, partitioned by width and stride.

The key of a stored item is its path, subtune, width, stride and content hash, so a change of any
of them builds anew and nothing stale is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "sid string, subtune int, content_md5 string, block_idx long, block array<smallint>, seq_len int, stride int"
KEY = ("sid", "subtune", "content_md5", "seq_len", "stride")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Append blocks (BLOCKS); rows of an item lie together and in order."""
    narrow = blocks.withColumn("block", F.col("block").cast("array<smallint>"))
    narrow.sortWithinPartitions("sid", "subtune", "block_idx").write.mode("append").partitionBy("seq_len", "stride").parquet(path)


def read_blocks(spark: SparkSession, path: str, seq_len: int, stride: int) -> DataFrame:
    """Blocks of one width and stride; the filter prunes partitions."""
    rows = spark.read.schema(BLOCKS).parquet(path).where((F.col("seq_len") == seq_len) & (F.col("stride") == stride))
    return rows.where(F.size("block") == F.lit(seq_len + 1))


def pending(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of manifest (with KEY) that the store has no block of."""
    return manifest.join(store.select(*KEY).distinct(), list(KEY), "left_anti")


def cache_decision(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """manifest with cached: whether the store holds at least one block under the row's key."""
    held = store.select(*KEY).distinct().withColumn("_held", F.lit(True))
    return manifest.join(held, list(KEY), "left").withColumn("cached", F.coalesce("_held", F.lit(False))).drop("_held")

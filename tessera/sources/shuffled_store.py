"""Blocks stored in a seeded order, so that a random sample is a range of the store.

The order is that of a hash of the block's number and the seed. A draw of any size takes a range of
places that begins at a place of its own for each epoch and wraps around; as rows lie by place, and
row groups know their first and last, only those of the range are read. Random access to single blocks
would touch nearly every row group instead.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import xy
from ..operators.block_index import PREFIX, seeded_key

#: Bytes of a row group, about: small enough that a range begins and ends near one's border.
GROUP_BYTES = 4 << 20
#: Blocks of a file, at most, about: a task sorts one file.
FILE_BLOCKS = 100_000


def write_shuffled(blocks: DataFrame, path: str, total: int, seed: int = 0, files: int = 64, group_bytes: int = GROUP_BYTES, file_blocks: int = FILE_BLOCKS) -> None:
    """Write blocks (global_idx, which are all numbers below total, block, ...) with their place.

    Blocks move once: a place is the number of hashes in lower cells, counted over the numbers alone,
    and the rank within the cell. The counts are a row for each of the 16 ** PREFIX cells at most, and are
    broadcast; files hold adjacent cells. There are `files` of them, or more, so that none has much over
    file_blocks: a task sorts one of them, however many blocks there are.
    """
    spark, cells = blocks.sparkSession, 16**PREFIX
    files = min(cells, max(files, -(-total // file_blocks)))
    named = lambda df: df.withColumn("_k", seeded_key(seed, "global_idx")).withColumn("_g", F.conv(F.substring("_k", 1, PREFIX), 16, 10).cast("long"))
    sizes = named(spark.range(total).withColumnRenamed("id", "global_idx")).groupBy("_g").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    dealt = named(blocks).withColumn("_file", F.floor(F.col("_g") * files / cells).cast("int")).repartitionById(files, F.col("_file"))
    rank = F.row_number().over(Window.partitionBy("_file", "_g").orderBy("_k", "global_idx")) - 1
    placed = dealt.withColumn("_r", rank).join(F.broadcast(firsts), "_g").withColumn("place", (F.col("_first") + F.col("_r")).cast("long"))
    placed = placed.drop("_k", "_g", "_file", "_first", "_r").sortWithinPartitions("place")
    placed.write.option("parquet.block.size", group_bytes).parquet(path)


def ranges(total: int, fraction: float, seed: int, epoch: int) -> list[tuple[int, int, int, int]]:
    """(pass, begin, first, end): of each pass over the store the places drawn, from first up to before
    end, and where the pass begins; what wraps around is a second range."""
    left, out, p = int(fraction * total), [], 0
    while left > 0:
        size = min(left, total)
        begin = int(hashlib.md5(f"{seed}|{epoch}|{p}".encode()).hexdigest()[:8], 16) % total
        out.append((p, begin, begin, min(total, begin + size)))
        if begin + size > total:
            out.append((p, begin, 0, begin + size - total))
        left, p = left - size, p + 1
    return out


def fetch(spark: SparkSession, path: str, fraction: float, seed: int = 0, epoch: int = 0) -> DataFrame:
    """int(fraction * blocks) draws: the store's columns with draw, from 0 on without gaps, and x and y.

    Nothing comes twice in a pass over the store; a fraction over 1 makes several. Every place is as
    likely to be drawn as any other. The filters on place reach the scan.
    """
    rows = spark.read.parquet(path)
    total = rows.count()
    x, y = xy(F.col("block"))
    found = None
    for p, begin, first, end in ranges(total, fraction, seed, epoch):
        draw = F.lit(p * total) + F.pmod(F.col("place") - begin, F.lit(total))
        own = rows.where((F.col("place") >= first) & (F.col("place") < end)).withColumns({"draw": draw.cast("long"), "x": x, "y": y})
        found = own if found is None else found.unionByName(own)
    return rows.withColumns({"draw": F.lit(0).cast("long"), "x": x, "y": y}).where(F.lit(False)) if found is None else found

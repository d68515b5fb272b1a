"""The index from a global block number to a file and a place in it, and orders over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_counts(blocks: DataFrame, *files: str) -> DataFrame:
    return blocks.groupBy(*files).agg(F.count("*").alias("n"))


#: File numbers per cell of the prefix sum, and characters of a hash that name a cell of a shuffle.
FILES = 4096
PREFIX = 4


def running(rows: DataFrame, cell: Column, order: list, value: str, out: str, *keys: str) -> DataFrame:
    """rows with column out: per keys (none: over all), the sum of value over all rows before, by cell
    and then by order. Keys and cells are not null.

    Sums are taken per cell first; only these, one row a cell, pass a single task per keys.
    """
    marked = rows.withColumn("_cell", cell)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = marked.groupBy(*keys, "_cell").agg(F.sum(value).alias("_s")).select(*keys, "_cell", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_f"))
    within = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = marked.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(firsts, [*keys, "_cell"]).withColumn(out, (F.col("_f") + F.col("_w")).cast("long")).drop("_cell", "_s", "_f", "_w")


def build_index(counts: DataFrame, order: str = "file_ord") -> DataFrame:
    """counts (order, a whole number; n, ...) with cum, the blocks of all files before. Files
    without blocks don't count."""
    cell = F.coalesce(F.floor(F.col(order) / FILES).cast("long"), F.lit(-1).cast("long"))
    return running(counts.where(F.col("n") > 0), cell, [order], "n", "cum")


def split_index(files: DataFrame, mention: str = "mention", line: str = "line_no") -> DataFrame:
    """files (split, mention, line_no, n, ...) with cum, the blocks of the same split before, in the
    order of mention (the place of the manifest that names the file among all) and line.

    Each split has numbers of its own from 0 on. Files without blocks don't count, and so neither do
    splits without any.
    """
    cell = F.struct(F.col(mention).alias("m"), F.floor(F.col(line) / FILES).cast("long").alias("l"))
    return running(files.where(F.col("n") > 0), cell, [mention, line], "n", "cum", "split")


def loaders(index: DataFrame, batch_size: int, train: str = "train") -> DataFrame:
    """(loader, split, n_blocks, n_batches) of split_index: a row per split that has blocks, the training
    split first and then by first mention. Splits are few; only a row of each passes one task."""
    size = F.lit(batch_size)
    per = index.groupBy("split").agg(F.min("split_ord").alias("_o"), F.sum("n").alias("n_blocks"))
    place = F.row_number().over(Window.orderBy(F.col("split") != train, "_o")) - 1
    return per.select(place.cast("int").alias("loader"), "split", "n_blocks", F.ceil(F.col("n_blocks") / size).cast("long").alias("n_batches"))


def with_global_index(blocks: DataFrame, index: DataFrame, *on: str) -> DataFrame:
    """blocks with global_idx, carried along instead of looked up later; on names what tells files
    apart (file_ord, if nothing is named)."""
    on = on or ("file_ord",)
    return blocks.join(index.select(*on, "cum"), list(on)).withColumn("global_idx", F.col("cum") + F.col("block_idx")).drop("cum")


#: Index entries per cell of the lookup.
CELL = 1024


def lookup(requests: DataFrame, index: DataFrame, on: str = "idx") -> DataFrame:
    """requests with file_ord and block_idx; numbers below 0 or beyond the end fail the query.

    The range condition becomes an equi-join on cells of CELL block numbers: a file is listed in
    the cells it reaches into, a request looks in its own cell.
    """
    total = index.agg(F.coalesce(F.max(F.col("cum") + F.col("n")), F.lit(0)).alias("total")).first()["total"]
    idx = F.when((F.col(on) < 0) | (F.col(on) >= total), F.raise_error(F.concat(F.lit("block index out of range: "), F.col(on).cast("string"))).cast("long")).otherwise(F.col(on))
    asked = requests.withColumn("_i", idx).withColumn("_cell", F.floor(F.col("_i") / CELL).cast("long"))
    cells = index.select("file_ord", "cum", "n", F.explode(F.sequence(F.floor(F.col("cum") / CELL).cast("long"), F.floor((F.col("cum") + F.col("n") - 1) / CELL).cast("long"))).alias("_cell"))
    found = asked.join(cells, (asked["_cell"] == cells["_cell"]) & (F.col("_i") >= F.col("cum")) & (F.col("_i") < F.col("cum") + F.col("n")))
    return found.select(*requests.columns, "file_ord", (F.col("_i") - F.col("cum")).alias("block_idx"))


def get_block(blocks: DataFrame, file_ord: int, block_idx: int = 0) -> DataFrame:
    """One block; both filters reach the scan."""
    return blocks.where((F.col("file_ord") == file_ord) & (F.col("block_idx") == block_idx))


def seeded_key(seed: int, *cols: str):
    """A hash of columns and seed to order by: the same on any cluster, and in SQL."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in cols), F.lit(str(seed))).cast("binary"))


def seeded_shuffle(files: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """files with a new file_ord, in the order of a seeded hash: files move, not their blocks."""
    keyed = files.withColumns({"_k": seeded_key(seed, key), "_one": F.lit(1)})
    return running(keyed, F.substring("_k", 1, PREFIX), ["_k", key], "_one", "file_ord").drop("_k", "_one")

"""Samples of exact size and batches. Orders are by seeded hashes, so they are the same anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .block_index import PREFIX, lookup, seeded_key


def _orders(rows: DataFrame, times: int, key: str, seed: int, epoch: int) -> DataFrame:
    """Each row once for each of so many orders: _p numbers the order, _k is the row's hash in it and
    _g the first characters of the hash. The first order's hash doesn't depend on how many there are."""
    orders = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    which = F.concat(F.lit(str(epoch)), F.when(F.col("_p") > 0, F.concat(F.lit("|"), F.col("_p").cast("string"))).otherwise(F.lit("")))
    keyed = orders.withColumn("_k", F.md5(F.concat(seeded_key(seed, key), which).cast("binary")))
    return keyed.withColumn("_g", F.substring("_k", 1, PREFIX))


def sample_exact(rows: DataFrame, fraction: float, key: str = "global_idx", seed: int = 0, epoch: int = 0) -> DataFrame:
    """int(fraction * rows) draws, in an order: rows with draw, from 0 on without gaps.

    Draws go through all rows in one order, then in another, and so on, and end within an order; so up
    to a fraction of 1 nothing comes twice, and at 2 each row comes twice. Fewer than one is none. An
    order is that of a seeded hash, the same anywhere; rows of one key and hash follow in any order.

    Rows are counted by the first characters of the hash. Of the last order, only the groups before the
    end are sorted; only counts, one a group, pass one task per order.
    """
    if fraction < 0:
        raise ValueError("the fraction must not be negative")
    n = rows.count()
    total = int(fraction * n)
    if not total:
        return rows.withColumn("draw", F.lit(0).cast("long")).where(F.lit(False))
    keyed = _orders(rows, -(-total // n), key, seed, epoch)
    sizes = keyed.groupBy("_p", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_p").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_p") * F.lit(n).cast("long") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    groups = sizes.select("_p", "_g", first.alias("_first")).where(F.col("_first") < total)
    place = F.row_number().over(Window.partitionBy("_p", "_g").orderBy("_k", key)) - 1
    drawn = keyed.join(groups, ["_p", "_g"]).withColumn("draw", (F.col("_first") + place).cast("long"))
    return drawn.where(F.col("draw") < total).select(*rows.columns, "draw")


def draws(df: DataFrame, n: int, total: int, seed: int = 0) -> DataFrame:
    """n draws with replacement from 0 to total - 1: (draw, idx)."""
    spark = df.sparkSession
    rows = spark.range(n).withColumnRenamed("id", "draw")
    number = F.conv(F.substring(seeded_key(seed, "draw"), 1, 8), 16, 10).cast("long")
    return rows.withColumn("idx", number % F.lit(total))


def sample_with_replacement(blocks: DataFrame, index: DataFrame, n: int, seed: int = 0) -> DataFrame:
    total = index.agg(F.sum("n")).first()[0] or 0
    return lookup(draws(blocks, n, total, seed), index)


def batches(rows: DataFrame, size: int, order: str = "global_idx", *values: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, batch, members): rows in the order of a dense number, size at a time; the last may be short.

    With keys (a split, say) each has numbers and batches of its own, and none straddles two. members
    are structs of the number and of values. The number itself gives the batch, so no global sort is
    needed, and a group is never more than size rows.
    """
    batch = F.floor(F.col(order) / size).cast("long").alias("batch")
    return rows.groupBy(*keys, batch).agg(F.sort_array(F.collect_list(F.struct(order, *values))).alias("members"))


def fan_out(rows: DataFrame, times: int) -> DataFrame:
    """Each row once per prediction number p."""
    return rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else rows.withColumn("p", F.lit(0)).where(F.lit(False))

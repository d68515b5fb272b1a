"""Named splits, limits on entries, and what was kept or skipped for which reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import frame_budget, duration_seconds, pick_time
from .block_index import FILES, running


def limit_entries(entries: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The first n entries (0: all; below 0: all but the last -n) by order, a number that isn't null,
    before anything is skipped. Below 0, entries are counted in cells; they don't pass one task."""
    if n == 0:
        return entries
    if n > 0:
        return entries.orderBy(order).limit(n)
    placed = running(entries.withColumn("_one", F.lit(1)), F.floor(F.col(order) / FILES).cast("long"), [order], "_one", "_place")
    return placed.where(F.col("_place") < entries.count() + n).drop("_one", "_place")


def union_splits(splits: list[tuple[str, DataFrame]], mentions: bool = False) -> DataFrame:
    """All rows of all splits, duplicates too, with split, split_ord, the place of the split's first
    mention, and, if asked for, mention, the place of this one; a split named again, or `train` among
    the evaluations, adds to the first."""
    order = {name: i for i, name in reversed(list(enumerate(dict.fromkeys(n for n, _ in splits))))}
    named = lambda i, n: {"split": F.lit(n), "split_ord": F.lit(order[n])} | ({"mention": F.lit(i)} if mentions else {})
    parts = [df.withColumns(named(i, n)) for i, (n, df) in enumerate(splits)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def select_split(splits: DataFrame, wanted: str) -> DataFrame:
    """The split to use of splits (split, split_ord): the wanted one, else `val`, else the first.

    No rows if there is none.
    """
    priority = F.when(F.col("split") == wanted, 0).when(F.col("split") == "val", 1).otherwise(2)
    best = splits.agg(F.min(F.struct(priority.alias("p"), "split_ord", "split")).alias("b"))
    return best.where("b IS NOT NULL").select("b.split", F.col("b.split_ord"))


def kept_skipped(entries: DataFrame) -> DataFrame:
    """Per split, entries without and with a skip_reason."""
    none = F.col("skip_reason").isNull()
    return entries.groupBy("split").agg(F.count_if(none).alias("kept"), F.count_if(~none).alias("skipped"))


def attach_budget(entries: DataFrame, durations: DataFrame, ntsc: bool = False) -> DataFrame:
    """entries (md5, subtune, ...) with frames, null where the key, the times or the subtune is missing."""
    joined = entries.join(durations, "md5", "left")
    return joined.withColumn("frames", frame_budget(duration_seconds(pick_time(F.col("times"), F.col("subtune"))), ntsc)).drop("times")


def skip_reason(has_source: Column, frames: Column, n_tokens: Column) -> Column:
    """Why an entry is left out, by the first test it fails; null: it is kept."""
    return F.when(~has_source, "no source").when(frames.isNull(), "no budget").when(n_tokens < 2, "too short")

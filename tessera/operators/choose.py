"""One row of many: the newest of the best class, or an explicit choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_with_fallback(rows: DataFrame, best: str, time: str, path: str, *keys: str) -> DataFrame:
    """Per keys the newest row of those where best holds, else the newest of all; the larger path
    on a tie. One aggregation, reduced map-side."""
    rank = F.struct(F.col(best).cast("int").alias("b"), F.col(time).alias("t"), F.col(path).alias("p"))
    return rows.groupBy(*keys).agg(F.max(rank).alias("x")).where("x IS NOT NULL").select(*keys, F.col("x.p").alias(path), F.col("x.t").alias(time), (F.col("x.b") == 1).alias(best))


def choose_checkpoint(rows: DataFrame, explicit: str | None, path: str = "path", time: str = "modified") -> str:
    """The path of a checkpoint: the explicit one, else the newest `best-*`, else the newest."""
    if explicit:
        return explicit
    named = rows.where(F.col(path).endswith(".ckpt")).withColumn("best", F.regexp_like(F.col(path), F.lit(r"(^|/)best-[^/]*$")))
    found = latest_with_fallback(named, "best", time, path).first()
    if not found:
        raise FileNotFoundError("no checkpoint")
    return found[path]


def prune_and_narrow(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep that there are, doubles as floats."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("float").alias(c) if kinds[c] == "double" else F.col(c) for c in keep if c in kinds))

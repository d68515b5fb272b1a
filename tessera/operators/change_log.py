"""Register states as change logs, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import PAL_CYCLES


def change_log(states: DataFrame, cycles: float = PAL_CYCLES, *keys: str) -> DataFrame:
    """(keys, clock, reg, val) of states (keys, frame, reg, val) where val differs from the same
    register's value before; the first frame is all changes. Null is a value."""
    w = Window.partitionBy(*keys, "reg").orderBy("frame")
    first = F.row_number().over(w) == 1
    rows = states.withColumn("_new", first | ~F.col("val").eqNullSafe(F.lag("val").over(w)))
    clock = (F.col("frame") * F.lit(cycles)).cast("long")
    return rows.where("_new").select(*keys, clock.alias("clock"), "reg", "val")


def forward_fill(log: DataFrame, grid: DataFrame, cycles: int = PAL_CYCLES, *keys: str) -> DataFrame:
    """grid (keys, frame, reg) with val: the last one logged at or before the frame."""
    at = log.withColumn("frame", F.round(F.col("clock") / cycles).cast("long")).select(*keys, "frame", "reg", "val")
    w = Window.partitionBy(*keys, "reg").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(at, [*keys, "frame", "reg"], "left").withColumn("val", F.last("val", ignorenulls=True).over(w))


def state_rows(df: DataFrame, state: str, *keys: str) -> DataFrame:
    """(keys, frame, reg, val) of a register vector per frame."""
    return df.select(*keys, "frame", F.posexplode(state).alias("reg", "val"))


def write_change_log(log: DataFrame, path: str, irq: int = PAL_CYCLES) -> None:
    """Write the log as Parquet, the frame's cycles as a column, ordered within its files."""
    log.withColumn("irq", F.lit(irq)).sortWithinPartitions("clock", "reg").write.parquet(path)

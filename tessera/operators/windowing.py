"""Token streams cut into padded windows of fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_count(length: Column, seq_len: int, stride: int) -> Column:
    """How many windows a stream of that length has: starts go on while a target is left, and stop
    with the first window that reaches the end. Streams of fewer than two tokens have none."""
    width = seq_len + 1
    by_start = F.ceil((length - 1) / F.lit(stride))
    by_end = F.greatest(F.lit(0), F.ceil((length - F.lit(width)) / F.lit(stride))) + 1
    return F.when((length < 2) | F.lit(stride < 1), F.lit(0)).otherwise(F.least(by_start, by_end)).cast("int")


def windows(df: DataFrame, ids: str, seq_len: int, stride: int | None = None) -> DataFrame:
    """df with block_idx and block in place of ids: a row per window of seq_len + 1 tokens.

    The array is sliced after the explode of indexes, all within a row's own stage; no shuffle. A
    stream without windows has a null index, which the explode drops: a filter would be pushed below
    what makes the tokens, and make them twice.
    """
    step, width = stride or seq_len, seq_len + 1
    n = window_count(F.size(ids), seq_len, step)
    rows = df.withColumn("block_idx", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return rows.withColumn("block", window_at(ids, F.col("block_idx"), step, width)).withColumn("block_idx", F.col("block_idx").cast("long")).drop(ids)


def window_at(ids: str, block_idx: Column, step: int, width: int) -> Column:
    """The window of that index, padded at its end."""
    part = F.slice(F.col(ids), block_idx.cast("int") * step + 1, F.lit(width))
    return F.concat(part, F.array_repeat(F.lit(0), F.lit(width) - F.size(part)))


def toy_tokens(text: Column, vocab: int) -> Column:
    """Model ids of a stand-in codec for tests and benchmarks: a word's id is its length.

    It stands for an external codec, whose body is not part of this engine (see boundary.py).
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    return F.transform(words, lambda w: F.length(w) % vocab + 1)

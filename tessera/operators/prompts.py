"""Prompts: the first block of a file that is long enough, split into a prompt and its truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import real_tokens


def select_prompts(blocks: DataFrame, n: int, prompt_len: int, gen_len: int) -> DataFrame:
    """(path, prompt, truth) of the first n files, by path, that have a qualifying block.

    A block qualifies if it has more than prompt_len real tokens and some truth. The first per
    file is a minimum, reduced map-side; a limit of 0 still yields one.
    """
    rows = blocks.withColumn("_r", real_tokens(F.col("block")))
    rows = rows.where((F.size("_r") >= prompt_len + 1) & (F.size(F.slice("_r", prompt_len + 1, gen_len)) > 0))
    first = rows.groupBy("path").agg(F.min(F.struct("block_idx", "_r")).alias("b"))
    return first.orderBy("path").limit(max(1, n)).select(
        "path", F.slice("b._r", 1, prompt_len).cast("array<bigint>").alias("prompt"), F.slice("b._r", prompt_len + 1, gen_len).cast("array<bigint>").alias("truth")
    )


def prompt_slice(sequences: DataFrame, ids: str, prompt_len: int, max_len: int) -> DataFrame:
    """sequences with prompt, n_generate and compare."""
    if max_len - prompt_len <= 0:
        raise ValueError("the maximum length must be above the prompt's")
    return sequences.withColumns({"prompt": F.slice(ids, 1, prompt_len), "n_generate": F.lit(max_len - prompt_len), "compare": F.slice(ids, 1, max_len)})


def continuation(pred: Column, truth: Column, decodes: Column) -> Column:
    """What is rendered: the prediction, or the truth where the prediction does not decode."""
    return F.when(F.coalesce(decodes, F.lit(False)), pred).otherwise(truth)

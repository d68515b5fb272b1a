"""Whole runs by one configuration: training batches, validation scores, the gate, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.expressions import argmax, cross_entropy, decode, overlap_accuracy, xy
from ..sources.npy_blocks import read_npy
from ..sources.shuffled_store import fetch
from .boundary import Codec, Generator, decodes, generate
from .metrics import batch_partials, epoch_scores, gate_report
from .prompts import continuation, prompt_slice, select_prompts
from .sampling import batches, fan_out
from .splits import select_split

#: Files tried for each prompt wanted, at first; then as many times more while prompts are missing.
TRIES = 4


def train_batches(spark: SparkSession, store: str, cfg: EngineConfig, epoch: int = 0) -> DataFrame:
    """(batch, members) of one epoch over a store in seeded order: a sample of cfg.shuffle, or, where
    that is 0, all blocks in the order of their numbers. members hold the draw or number, x and y."""
    if cfg.shuffle:
        return batches(fetch(spark, store, cfg.shuffle, cfg.seed, epoch), cfg.batch_size, "draw", "x", "y")
    x, y = xy(F.col("block"))
    return batches(spark.read.parquet(store).withColumns({"x": x, "y": y}), cfg.batch_size, "global_idx", "x", "y")


def validate(scored: DataFrame, cfg: EngineConfig, split: str = "split", batch: str = "batch") -> DataFrame:
    """The epoch's scores of scored (split, batch, y, logits), a row per token; padding (y = 0) has no loss."""
    loss = F.when(F.col("y") != 0, cross_entropy(F.col("logits"), F.col("y"), cfg.label_smoothing)).otherwise(F.lit(0.0))
    tokens = scored.select(split, batch, "y", argmax(F.col("logits")).alias("pred"), loss.alias("loss"))
    return epoch_scores(batch_partials(tokens, split, batch), split)


def gate_prompts(counted: DataFrame, cfg: EngineConfig, path: str = "path") -> DataFrame:
    """(path, prompt, truth) of the first cfg.n_prompts files, by path, that have a block which qualifies.

    counted (path, size, n_blocks) is the listing. Files are opened in the order of their paths, a few for
    each prompt wanted, and more only while prompts are missing.
    """
    files = counted.where(F.col("n_blocks") > 0).select(F.col(path).alias("path"), "size", "n_blocks")
    total, k = files.count(), TRIES * max(1, cfg.n_prompts)
    while True:
        found = select_prompts(read_npy(files.orderBy("path").limit(k), cfg.seq_len), cfg.n_prompts, cfg.prompt_seq_len, cfg.gen_tokens)
        if k >= total or found.count() >= max(1, cfg.n_prompts):
            return found
        k *= TRIES


def run_gate(counted: DataFrame, generator: Generator, codec: Codec, cfg: EngineConfig) -> DataFrame:
    """The gate from a listing to its report: prompts are continued, compared with their truth, and
    decoded together with it. The report is one row, for gate_json and require."""
    rows = gate_prompts(counted, cfg).withColumn("pred", generate(generator, F.col("prompt"), cfg.gen_tokens))
    rows = rows.withColumn("pred", F.slice("pred", 1, F.size("truth")))
    full = decode(F.concat("prompt", "pred"), cfg.vocab)
    scored = rows.select("path", overlap_accuracy(F.col("truth"), F.col("pred")).alias("acc"), decodes(codec, full).alias("decodes"))
    return gate_report(scored, cfg.min_acc, cfg.grammar_min)


def predict(blocks: DataFrame, generator: Generator, codec: Codec, cfg: EngineConfig, start_seq: int = 0, start_block: int = 0) -> DataFrame:
    """(p, ids, truth, acc, decodes, program) of cfg.predictions continuations of one block.

    blocks (split, split_ord, file_ord, block_idx, block): the split is cfg.predict_set, else `val`, else
    the first. acc is null where nothing is left to compare with, below cfg.min_acc the query fails;
    program is what is rendered, the truth where the prediction does not decode.
    """
    chosen = select_split(blocks.select("split", "split_ord").distinct(), cfg.predict_set).select("split")
    here = (F.col("file_ord") == start_seq) & (F.col("block_idx") == start_block)
    one = blocks.where(here).join(F.broadcast(chosen), "split")  # one row, as split_ord tells splits apart
    cut = prompt_slice(one.select(F.col("block").cast("array<bigint>").alias("block")), "block", cfg.prompt_seq_len, cfg.max_seq_len)
    rows = fan_out(cut, cfg.predictions)
    rows = rows.withColumn("pred", generate(generator, F.col("prompt"), cfg.max_seq_len - cfg.prompt_seq_len))
    left = F.slice("compare", cfg.prompt_seq_len + 1, cfg.max_seq_len)
    acc = F.when(F.size(left) > 0, overlap_accuracy(left, F.col("pred")))
    low = F.raise_error(F.concat(F.lit("accuracy below the least wanted: "), F.coalesce(acc.cast("string"), F.lit("none")))).cast("double")
    acc = F.when(F.coalesce(acc < cfg.min_acc, F.lit(True)), low).otherwise(acc) if cfg.min_acc else acc
    ids = F.concat("prompt", "pred")
    rows = rows.select("p", ids.alias("ids"), F.col("compare").alias("truth"), acc.alias("acc"), decodes(codec, decode(ids, cfg.vocab)).alias("decodes"))
    return rows.withColumn("program", decode(continuation(F.col("ids"), F.col("truth"), F.col("decodes")), cfg.vocab))

"""Scores of predictions: masked, by subset, over all, and per class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold


def masked_mean(v: Column, y: Column) -> Column:
    """The mean of v where y is no padding; 0 where all is."""
    return F.sum(F.when(y != 0, v).otherwise(F.lit(0.0))) / F.greatest(F.count_if(y != 0), F.lit(1))


def batch_partials(tokens: DataFrame, *keys: str) -> DataFrame:
    """Sums per batch of tokens (y, pred, loss): a batch of padding alone counts one token."""
    real = F.col("y") != 0
    return tokens.groupBy(*keys).agg(
        F.sum(F.when(real, F.col("loss")).otherwise(F.lit(0.0))).alias("loss_sum"),
        F.count_if(real & (F.col("y") == F.col("pred"))).alias("correct_sum"),
        F.greatest(F.count_if(real), F.lit(1)).alias("tok_sum"),
    )


def subset_metrics(partials: DataFrame, *keys: str) -> DataFrame:
    """Token-weighted loss and accuracy of each subset."""
    sums = partials.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("loss_sum", "correct_sum", "tok_sum")))
    return sums.withColumns({"loss": F.col("loss_sum") / F.col("tok_sum"), "acc": F.col("correct_sum") / F.col("tok_sum")})


def micro_macro(partials: DataFrame, split: str = "split") -> DataFrame:
    """One row: token-weighted (micro) and unweighted (macro) means over subsets with tokens."""
    per = subset_metrics(partials, split).where(F.col("tok_sum") > 0)
    return per.agg(
        (F.sum("loss_sum") / F.sum("tok_sum")).alias("micro_loss"), (F.sum("correct_sum") / F.sum("tok_sum")).alias("micro_acc"),
        F.avg("loss").alias("macro_loss"), F.avg("acc").alias("macro_acc"), F.count("*").alias("subsets"),
    )


def epoch_scores(partials: DataFrame, split: str = "split") -> DataFrame:
    """One row, what an epoch is judged by: val_loss and val_acc are the token-weighted means over all
    subsets, or, of a single subset, the plain means of its batches' means."""
    several = F.min(split) != F.max(split)
    of = lambda c: F.when(several, F.sum(c) / F.sum("tok_sum")).otherwise(F.avg(F.col(c) / F.col("tok_sum")))
    return partials.agg(of("loss_sum").alias("val_loss"), of("correct_sum").alias("val_acc"))


def micro_rollup(partials: DataFrame, split: str = "split") -> DataFrame:
    """Subsets and the total in one pass; the total's split is null."""
    return partials.rollup(split).agg(F.sum("loss_sum").alias("loss_sum"), F.sum("correct_sum").alias("correct_sum"), F.sum("tok_sum").alias("tok_sum"))


def compare(truth: DataFrame, pred: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, gt, pred): predictions by position, with gt null beyond the truth's end."""
    t = truth.select(*keys, F.posexplode("ids").alias("i", "gt"))
    p = pred.select(*keys, F.posexplode("ids").alias("i", "pred"))
    return p.join(t, [*keys, "i"], "left").select(*keys, "i", "gt", "pred")


def write_compare(pairs: DataFrame, path: str) -> None:
    """pairs (i, gt, pred, ...) as CSV with a head line; gt is blank beyond the truth's end."""
    pairs.withColumn("gt", F.coalesce(F.col("gt").cast("string"), F.lit(""))).write.option("header", True).option("emptyValue", "").csv(path)


def macro_accuracy(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per-class recall of pairs (gt, pred), averaged over the classes that are in either.

    A class that was only predicted has recall 0.
    """
    classes = pairs.withColumn("cls", F.explode(F.array_distinct(F.array("gt", "pred"))))
    own = classes.groupBy(*keys, "cls").agg(F.count_if(F.col("gt") == F.col("cls")).alias("n"), F.count_if((F.col("gt") == F.col("cls")) & (F.col("pred") == F.col("cls"))).alias("hit"))
    recall = F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(F.lit(0.0))
    return own.groupBy(*keys).agg(F.avg(recall).alias("macro_accuracy"))


def best_epoch(history: DataFrame, metric: str = "val_loss", epoch: str = "epoch", *keys: str) -> DataFrame:
    """The epoch with the least metric, the earlier one on a tie."""
    return history.groupBy(*keys).agg(F.min(F.struct(metric, epoch)).alias("b")).select(*keys, f"b.{epoch}", f"b.{metric}")


def early_stop(history: DataFrame, metric: str, epoch: str, patience: int, min_delta: float, *keys: str, threshold: float | None = None) -> DataFrame:
    """history with best, wait, reason, stop and ran, for a metric that should fall, checked epoch by epoch.

    The best moves only where a gain is accepted, that is, where metric + min_delta is below it; so slow
    steady progress adds up until it counts. wait is the number of checks since, and patience bounds it: checks count, not epoch numbers.
    reason says why training stops: `not finite` (null too), `threshold` (below it, if there is one) or
    `patience`, tried in this order; the first two leave best and wait as they are. Training ends with
    the first stop, and ran is false in the rows after it, which repeat the last best and wait.
    """
    if patience < 1 or min_delta < 0:
        raise ValueError("patience must be positive and min_delta not negative")

    def step(state: tuple, value: float | None) -> tuple:
        best, wait, over = state
        reason = None
        if over:
            return state, (best, wait, None, False, False)
        if value is None or not math.isfinite(value):
            reason = "not finite"
        elif threshold is not None and value < threshold:
            reason = "threshold"
        elif best is None or value + min_delta < best:
            best, wait = float(value), 0
        else:
            wait += 1
            reason = "patience" if wait >= patience else None
        return (best, wait, reason is not None), (best, wait, reason, reason is not None, True)

    return ordered_fold(history, list(keys), [epoch], lambda: (None, 0, False), step, [metric], "best double, wait int, reason string, stop boolean, ran boolean")


def gate_report(scored: DataFrame, min_acc: float, grammar_min: float, with_prompts: bool = True) -> DataFrame:
    """One row over scored (path, acc, decodes): means, thresholds, verdict and, if wanted, the prompts;
    with no prompts the gate fails and says so. Prompts meet in this row, so they should be few, as a
    limit makes them; without them, only sums do, and gate_lines writes each prompt by itself."""
    n = F.count("*")
    each = F.sort_array(F.collect_list(F.struct("path", "acc", "decodes")))
    rate = F.avg(F.col("decodes").cast("int"))
    ok = (n > 0) & F.coalesce((F.avg("acc") >= min_acc) & (rate >= grammar_min), F.lit(False))
    return scored.agg(
        ok.alias("passed"), F.avg("acc").alias("mean_greedy_acc"), rate.alias("decode_rate"), n.alias("n_prompts"),
        F.lit(min_acc).alias("min_acc"), F.lit(grammar_min).alias("grammar_min"),
        F.when(n == 0, F.lit("no prompts")).alias("reason"), *([each.alias("per_prompt")] if with_prompts else []),
    )


def gate_lines(scored: DataFrame, min_acc: float, grammar_min: float) -> DataFrame:
    """(line): the report without prompts as one line of JSON, and a line for each prompt, however many."""
    report = gate_json(gate_report(scored, min_acc, grammar_min, with_prompts=False))
    return report.unionByName(scored.select(F.to_json(F.struct("path", "acc", "decodes")).alias("line")))


def gate_json(report: DataFrame) -> DataFrame:
    """The report as one line of JSON; the prefix is a fixed value that readers look for."""
    return report.select(F.concat(F.lit("EVENT_GATE_RESULT "), F.to_json(F.struct("*"))).alias("line"))


def require(report: DataFrame, column: str = "passed") -> None:
    """Fail fast where a gate did not pass."""
    if not report.select(column).first()[0]:
        raise RuntimeError("the gate did not pass")

"""Analytics over logged training curves: history(run, split, epoch, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.metrics import half_even
from corpuslab.plans.scale import running

CURVES = ("train_f1", "val_f1", "train_accuracy", "val_accuracy")


def split_peaks(history: DataFrame, run: str, split: str, curves: Sequence[str] = CURVES) -> DataFrame:
    """Maximum of each curve over the epochs of a split."""
    return history.groupBy(run, split).agg(*(F.max(c).alias(c) for c in curves))


def run_peaks(history: DataFrame, run: str, split: str, curves: Sequence[str] = CURVES) -> DataFrame:
    """Best and rounded mean over splits of the split maxima."""
    peaks = split_peaks(history, run, split, curves)
    return peaks.groupBy(run).agg(
        *(F.max(c).alias(f"best_{c}") for c in curves),
        *(half_even(F.avg(c)).alias(f"avg_{c}") for c in curves),
    )


def best_epoch(history: DataFrame, by: Sequence[str], score: str = "val_f1") -> DataFrame:
    """1-based epoch of the first maximum."""
    first = F.struct((-F.col(score)).alias("s"), F.col("epoch").alias("e"))
    return history.groupBy(*by).agg((F.min_by("epoch", first) + 1).alias("best_epoch"))


def early_stop(history: DataFrame, run: str, loss: str, patience: int) -> DataFrame:
    """(run, stop_epoch): the epoch at which training would stop, null if it never does.

    An epoch improves when its loss is strictly below every earlier one; the run stops at the
    first epoch more than ``patience`` epochs after the latest improvement.
    """
    seen = running(history.select(run, "epoch", loss), run, "epoch", loss, "min", "_before")
    improves = F.col("_before").isNull() | (F.col(loss) < F.col("_before"))
    marked = seen.withColumn("_hit", F.when(improves, F.col("epoch")))
    latest = running(marked, run, "epoch", "_hit", "max", "_latest")
    waits = F.col("_hit").isNull() & (F.col("epoch") - F.col("_latest") > patience)
    return latest.groupBy(run).agg(F.min(F.when(waits, F.col("epoch"))).alias("stop_epoch"))


def leaderboard_best(runs: DataFrame, score: str = "avg_val_f1", run: str = "run") -> DataFrame:
    """The run with the greatest score, ties to the smallest run."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(run).alias("r"))
    return runs.agg(F.min_by(run, rank).alias(run), F.max(score).alias(score))

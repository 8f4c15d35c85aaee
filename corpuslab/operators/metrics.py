"""Classification metrics from predictions (by.., y, yhat). Everything after the confusion
counts works on labels x labels rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "y", "yhat").agg(F.count("*").alias("n"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_label(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, support for every true or predicted label; 0 when undefined."""
    cells = confusion(predictions, by)
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred")),
    )
    counts = (
        cells.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.true").alias("support"), F.sum("s.pred").alias("pred"))
    )
    return counts.select(
        *by, "label",
        _share(F.col("tp"), F.col("pred")).alias("precision"),
        _share(F.col("tp"), F.col("support")).alias("recall"),
        _share(2.0 * F.col("tp"), F.col("support") + F.col("pred")).alias("f1"),
        "support", "tp",
    )


def accuracy_f1(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., accuracy, f1): macro F1 over the union of true and predicted labels."""
    return per_label(predictions, by).groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1")
    )


def classification_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-label rows plus accuracy, macro and weighted average rows."""
    labels = per_label(predictions, by)
    total = F.sum("support")
    sums = labels.groupBy(*by).agg(
        (F.sum("tp") / total).alias("acc"),
        *(F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")),
        *((F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in ("precision", "recall", "f1")),
        total.alias("support"),
    )
    none = F.lit(None).cast("double")

    def row(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1")
        )

    summary = sums.select(
        *by, "support",
        F.explode(
            F.array(
                row("accuracy", none, none, F.col("acc")),
                row("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
                row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
            )
        ).alias("s"),
    ).select(*by, "s.*", "support")
    own = labels.select(*by, F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    return own.unionByName(summary)


def half_even(value: Column, digits: int = 2) -> Column:
    """Rounded half to even. A mean depends in its last bits on the order in which tasks added it up, so
    nine further digits are rounded first: a tie stays a tie whatever that order was."""
    scale = F.lit(10.0**digits)
    return F.bround(F.round(value * scale, 9), 0) / scale


def run_summary(split_metrics: DataFrame, by: Sequence[str], digits: int = 2) -> DataFrame:
    """Best and mean F1 and accuracy over splits, rounded half to even."""
    return split_metrics.groupBy(*by).agg(
        half_even(F.max("f1"), digits).alias("best_f1"),
        half_even(F.avg("f1"), digits).alias("avg_f1"),
        half_even(F.max("accuracy"), digits).alias("best_accuracy"),
        half_even(F.avg("accuracy"), digits).alias("avg_accuracy"),
    )


def best_params(split_metrics: DataFrame, by: Sequence[str], params: str, split: str = "split") -> DataFrame:
    """Parameters of the split with the best F1, ties to the earliest split."""
    rank = F.struct(F.round("f1", 12).alias("f1"), (-F.col(split)).alias("split"))
    return split_metrics.groupBy(*by).agg(F.max_by(params, rank).alias("best_params"))


def prediction_table(
    predictions: DataFrame, text: str, generated: str, y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    return predictions.select(
        F.col(text).alias("original_text"), F.col(yhat).alias("predicted_label"),
        F.col(y).alias("original_label"), F.col(generated).alias("predicted_text"),
    )

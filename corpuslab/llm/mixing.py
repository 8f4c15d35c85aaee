"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a budget of words. Complete epochs come first: a source whose budget is f times
its size takes every document floor(f) times. The rest of the budget is filled by an
Efraimidis-Spirakis draw: each document has the exponential key ``-ln(u) / w`` with its quality
weight w and a uniform u drawn from the hash of its id, documents are sorted by key within their
source, and sizes are prefix-summed up to the rest. The document that crosses the budget is taken
if that brings the sum nearer to it, so a source misses its budget by half a document at most.

The sort is one range-partitioned sort over (source, key); offsets come from one row per
partition and source, so a source with most of the rows is spread over all tasks.

Defined results: null, empty and blank texts have size 0 and add nothing; a null source is a source of
its own, last in order; a null id draws like the id ''; repeated rows are drawn each for itself
with the same key; weights that are null or not positive count as the smallest weight;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from corpuslab.plans.scale import cut_lineage, global_rank

LEAST_WEIGHT = 1e-6
_ROW = (1 << 33) - 1  # monotonically_increasing_id counts rows of a partition below bit 33


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the hash of an id; the same in every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(_src, source_size, target) for one row (_src, source, source_size) per source.

    Weights repeat over the sources in code point order. A source stops at ``most`` times its
    size; what is over goes to the others by weight. All that are below share one level, which rises
    until no further source is above: each step is one aggregate of two numbers.
    """
    ranked = global_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], name="_rank")
    repeat = F.array(*(F.lit(float(w)) for w in weights))
    ranked = cut_lineage(ranked.withColumn("_w", F.get(repeat, (F.col("_rank") % len(weights)).cast("int"))).withColumn(
        "_cap", F.lit(float(most)) * F.col("source_size")))
    first = ranked.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    total = share * (first.n or 0)
    level = total / first.w if first.w else 0.0
    while True:
        capped = F.col("_cap") <= F.lit(level) * F.col("_w")
        row = ranked.agg(F.sum(F.when(capped, F.col("_cap"))).alias("c"), F.sum(F.when(~capped, F.col("_w"))).alias("w")).first()
        following = (total - (row.c or 0.0)) / row.w if row.w else level
        if following <= level:
            break
        level = following
    reach = F.lit(level) * F.col("_w")
    return ranked.select("_src", "source_size", F.when(F.col("_cap") <= reach, F.col("_cap")).otherwise(reach).alias("target"))


def prefix_sums(df: DataFrame, within: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before, in ``order`` within a group of any size."""
    placed = cut_lineage(df.orderBy(within, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftrightunsigned("_at", 33))
    earlier = W.Window.partitionBy(within).orderBy("_pid").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = placed.groupBy(within, "_pid").agg(F.sum(value).alias("_sum")).select(
        within, "_pid", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    inside = W.Window.partitionBy("_pid", within).orderBy("_at").rowsBetween(W.Window.unboundedPreceding, -1)
    return placed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(
        offsets, ["_pid", within]).withColumn(name, F.col("_off") + F.col("_in")).drop("_pid", "_at", "_in", "_off")


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weight: str = "weight",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0,
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken), one row per input row.

    ``docs`` needs only the id, the source, the size in words and the quality weight; keep texts
    out of it and join the copies afterwards.
    """
    drawn = docs.select(
        F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), F.col(size).cast("long").alias("size"),
        F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT)).alias("_weight"),
    ).withColumn("_src", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))).withColumn(
        "_draw", -F.log(uniform(F.coalesce(F.col("_key").cast("string"), F.lit("")), seed)) / F.col("_weight"))
    drawn = cut_lineage(drawn)
    sizes = drawn.groupBy("_src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    sums = cut_lineage(prefix_sums(drawn, "_src", ["_draw", "_key", "size"], "size", "_before"))
    rows = sums.join(targets, "_src")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    chosen = (rest > 0) & (F.col("_before") + F.col("size") / F.lit(2.0) <= rest)
    rows = rows.withColumn("_epochs", epochs.cast("long")).withColumn(
        "copies", F.col("_epochs") + F.when(chosen, 1).otherwise(0))
    return rows.select(
        F.col("_key").alias(key), "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def length_weight(size: Column) -> Column:
    """The quality weight that the query and the pipeline give: short texts are drawn later."""
    return F.lit(0.25) + F.lit(0.75) * F.least(size, F.lit(200)).cast("double") / F.lit(200.0)

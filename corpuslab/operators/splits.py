"""Reproducible stratified splits. A class is never ordered in one task: the md5 order is
cut by bucket counts, and only the bucket holding a cut is ranked."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.plans.scale import global_rank, measured


def bucket_digits(rows: int) -> int:
    """Hash digits that cut so many rows in about as many buckets as a bucket has rows, so that neither
    the bucket counts nor the bucket with a cut grow faster than the square root."""
    return max(1, math.ceil(math.log2(max(rows, 2)) / 8))


def split_hash(key: str, split: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), split.cast("string"), F.lit(seed).cast("string")))


def _cut_points(rows: DataFrame, strata: Sequence[str], key: str, take: Column, name: str) -> DataFrame:
    """(strata, name): the (hash, key) of the last row taken when ``take`` rows of each
    stratum are taken in hash order; null when none is."""
    strata = list(strata)
    upto = Window.partitionBy(*strata).orderBy("_bucket")
    sizes = rows.groupBy(*strata, "_bucket").agg(F.count("*").alias("_c"))
    located = (
        sizes.withColumn("n", F.sum("_c").over(Window.partitionBy(*strata)))
        .withColumn("_take", take)
        .withColumn("_upto", F.sum("_c").over(upto))
        .filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_c") < F.col("_take")))
        .select(*strata, "_bucket", (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_left"))
    )
    in_bucket = Window.partitionBy(*strata).orderBy("_h", key)
    return (
        rows.join(measured(located), [*strata, "_bucket"])
        .withColumn("_rn", F.row_number().over(in_bucket))
        .filter(F.col("_rn") == F.col("_left"))
        .select(*strata, F.struct("_h", key).alias(name))
    )


def hash_split(
    docs: DataFrame, key: str, strata: Sequence[str], cuts: Sequence[tuple[str, Column]],
    rest: str, split: Column, seed: int,
) -> DataFrame:
    """Adds role. ``cuts`` are (role, rows to take cumulatively) with ``n`` the stratum size;
    rows past the last cut get ``rest``. The full table is only scanned: the cut points have
    one row per stratum."""
    digits = bucket_digits(docs.count())
    rows = docs.withColumn("_h", split_hash(key, split, seed)).withColumn(
        "_bucket", F.substring("_h", 1, digits)
    )
    slim = rows.select(*strata, key, "_h", "_bucket")
    out, role = rows, F.lit(rest)
    for i, (_, take) in enumerate(cuts):
        points = _cut_points(slim, strata, key, take, f"_cut{i}")
        out = out.join(measured(points), list(strata), "left")
    for i, (name, _) in reversed(list(enumerate(cuts))):
        inside = F.struct(F.col("_h"), F.col(key)) <= F.col(f"_cut{i}")
        role = F.when(F.coalesce(inside, F.lit(False)), F.lit(name)).otherwise(role)
    return out.withColumn("role", role).select(*docs.columns, "role")


def stratified_splits(
    docs: DataFrame, key: str, label: str, n_splits: int = 5, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """(docs.., split, role): independent stratified splits, role 'test' or 'train'."""
    many = docs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    test = F.round(F.col("n") * F.lit(test_share)).cast("long")
    return hash_split(many, key, ["split", label], [("test", test)], "train", F.col("split"), seed)


def three_way_split(
    docs: DataFrame, key: str, label: str, held_out: float = 0.1, seed: int = 42
) -> DataFrame:
    """(docs.., role): train, with the held-out share halved into eval and test."""
    held = F.round(F.col("n") * F.lit(held_out)).cast("long")
    cuts = [("eval", F.ceil(held / 2)), ("test", held)]
    return hash_split(docs, key, [label], cuts, "train", F.lit(0), seed)


def stratified_folds(docs: DataFrame, label: str, seq: str, k: int = 5) -> DataFrame:
    """Adds fold: contiguous blocks of each class in input order, the first ones longer."""
    ranked = global_rank(docs, [seq], within=[label], name="_r")
    sizes = docs.groupBy(label).agg(F.count("*").alias("_n"))
    small = F.floor(F.col("_n") / k)
    longer = F.col("_n") % k
    edge = longer * (small + 1)
    fold = F.when(F.col("_r") < edge, F.floor(F.col("_r") / (small + 1))).otherwise(
        longer + F.floor((F.col("_r") - edge) / F.greatest(small, F.lit(1)))
    )
    return ranked.join(measured(sizes), label).withColumn("fold", fold.cast("int")).select(
        *docs.columns, "fold"
    )

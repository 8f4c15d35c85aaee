"""Shared pieces: table readers, words, written intermediates and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.plans.scale import cut_lineage

#: A word is a run of characters outside these (fixed values of the contracts).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one task per core: small inputs arrive in fewer splits than there are cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, which bound what a Python worker holds of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under numbered column names, which no working column clashes with, and the number of
    each name."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def word_array(text: str | Column) -> Column:
    """The words of a text; null and blank texts have none."""
    col = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: str | Column) -> Column:
    """Number of words without keeping them: a text has one more word than inner space runs."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links``, for every
    node that has a link.

    Alternating stars: every node points its larger neighbours at the smallest node it knows,
    then its smaller ones; both steps are a partial ``min`` and a join, so a hub is neither
    grouped nor collected. The remaining pairs are checkpointed each round and shrink to one
    star per component. The rounds end when a round changes nothing: sums of hashes and counts
    of the pairs agree.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    pairs = links.select(hi, lo).filter("u <> v").distinct()
    pairs = cut_lineage(pairs)
    state = _signature(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        pairs = cut_lineage(small)
        now = _signature(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row.n, row.h

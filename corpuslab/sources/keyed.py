"""One JSON object of many entries as rows, read by byte ranges.

Spark splits the file at commas, which any text reader can do from any byte; what a comma means depends on all
that stands before it. Each fragment is counted for both cases, starting inside a string or outside; prefix
sums of the quotes tell which one holds, prefix sums of the braces the depth after it, and prefix sums of the
commas at depth one the entry it belongs to. Sums run inside a byte range and over one row per range, so a
file of any size is read by as many tasks as it has ranges; only the fragments of one entry meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.plans.scale import cut_lineage

_RANGE = ["_file", "_block"]


def _braces(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _with_prefix(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier fragments of the file as ``name``."""
    rows = rows.withColumn("_v", value.cast("long"))
    per_range = rows.groupBy(*_RANGE).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(*_RANGE, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*_RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, _RANGE).withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return placed.drop("_start", "_v")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, entry): every entry of the files' objects as the text of an object of its own."""
    bare = F.regexp_replace("value", r"\\.", "")  # an escape never spans a comma
    parts = F.split(bare, '"', -1)
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "")
    inside = F.array_join(F.filter(parts, lambda _, i: i % 2 == 1), "")
    fragments = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), (F.size(parts) - 1).alias("_quotes"), _braces(outside).alias("_out"),
        _braces(inside).alias("_in"))
    rows = _with_prefix(cut_lineage(fragments), F.col("_quotes"), "_q")
    rows = cut_lineage(rows.withColumn("_delta", F.when(F.col("_q") % 2 == 0, F.col("_out")).otherwise(F.col("_in"))))
    rows = _with_prefix(rows, F.col("_delta"), "_d")
    ends = ((F.col("_q") + F.col("_quotes")) % 2 == 0) & (F.col("_d") + F.col("_delta") == 1)
    rows = _with_prefix(cut_lineage(rows.withColumn("_ends", ends.cast("int"))), F.col("_ends"), "_entry")
    whole = rows.groupBy("_file", "_entry").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda r: r["value"]), ",").alias("_t"),
        F.max("_ends").alias("_ends"))
    opened = F.when(F.col("_entry") == 0, F.col("_t")).otherwise(F.concat(F.lit("{"), "_t"))
    closed = F.when(F.col("_ends") == 1, F.concat(opened, F.lit("}"))).otherwise(opened)
    return whole.select(F.col("_file").alias("file"), F.col("_entry").alias("seq"), closed.alias("entry"))


def read_keyed(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """(seq, key, value) of the entries of JSON objects, seq by place in the file."""
    parsed = F.from_json("entry", T.MapType(T.StringType(), value))
    return entries(spark, path).select(F.col("seq").cast("int").alias("seq"), F.explode(parsed).alias("key", "value"))

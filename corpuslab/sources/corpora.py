"""Readers and writers. Paths are arguments; operators never touch files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.sources.keyed import read_keyed

CORPUS_DOC = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("text", T.MapType(T.StringType(), T.StringType())),
    T.StructField("doi", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("rd", T.StringType()),
])
NODE_METADATA = T.StructType([
    T.StructField("publisher", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("subject", T.ArrayType(T.StringType())),
    T.StructField("articletitle", T.StringType()),
    T.StructField("journaltitle", T.StringType()),
])
PREPARED_COLUMNS = T.StructType([
    T.StructField(name, T.ArrayType(T.StringType())) for name in ("id", "title", "abstract", "full_text", "label")
] + [T.StructField("sections", T.ArrayType(T.ArrayType(T.StringType())))])


def read_keyed_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents keyed by name in one JSON object, read by byte ranges; sections as ordered array<struct<name, text>>."""
    sections = F.transform(
        F.map_entries("value.text"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text"))
    )
    return read_keyed(spark, path, CORPUS_DOC).select(
        "seq", "key", "value.title", "value.abstract", sections.alias("sections"),
        "value.doi", "value.file_name", F.col("value.rd").alias("label"),
    )


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same documents as JSON Lines, one per line: splittable."""
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), *CORPUS_DOC.fields])
    docs = spark.read.schema(schema).json(path)
    sections = F.transform(
        F.map_entries("text"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text"))
    )
    return docs.select(
        "seq", "key", "title", "abstract", sections.alias("sections"), "doi", "file_name", F.col("rd").alias("label")
    )


def read_parallel_lists(spark: SparkSession, path: str, schema: T.StructType = PREPARED_COLUMNS) -> DataFrame:
    """Column-oriented JSON (one list per column) as rows with their position ``seq``."""
    wide = spark.read.schema(schema).json(path, multiLine=True)
    zipped = F.arrays_zip(*(F.col(c) for c in schema.fieldNames()))
    return wide.select(F.posexplode(zipped).alias("seq", "r")).select("seq", "r.*")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """edges(src, dst) from an adjacency-list JSON object."""
    lists = read_keyed(spark, path, T.ArrayType(T.StringType()))
    return lists.select(F.col("key").alias("src"), F.explode("value").alias("dst"))


def read_node_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Node metadata with every field nullable."""
    return read_keyed(spark, path, NODE_METADATA).select(F.col("key").alias("id"), "value.*")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Frame annotations, chunks, word vectors, node features and edges live in Parquet."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """CSV with header and a leading 0-based index column. A report has one row per run
    configuration, so one file is written."""
    from corpuslab.plans.scale import global_rank

    indexed = global_rank(report, order, name="index")
    text = [F.col("index"), *(F.col(c).cast("string").alias(c) for c in report.columns)]
    indexed.select(*text).orderBy("index").coalesce(1).write.mode(mode).option("header", True).csv(path)

"""A corpus pipeline of five stages over the documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import bpe, mixing, quality, simhash, suffix
from corpuslab.llm.common import spread, table, word_count
from corpuslab.llm.queries import vocabulary
from corpuslab.plans.scale import cut_lineage

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.add_statistics(docs.select(*DOCUMENTS))
    cutoffs = quality.fit_cutoffs(scored, table(spark, sf_dir, "labels"), pool=True)
    return quality.judge(scored, cutoffs).filter("kept").select(*DOCUMENTS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, and one of the rows that share it. Rows without
    an id go if their fingerprint's group has one with an id; else one row of each fingerprint stays."""
    own = docs.select(*DOCUMENTS).withColumn("_row", F.xxhash64(*DOCUMENTS, *(F.col(c).isNull() for c in DOCUMENTS)))
    found = cut_lineage(simhash.near_duplicates(spread(own), carry=["_row"]))
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = found.filter(head).withColumn("_print", F.when(F.col("doc_id").isNull(), F.col("fp")))
    shared = cut_lineage(heads.groupBy("doc_id", "_print").agg(  # ids or fingerprints that several rows head a group with
        F.count("*").alias("n"), F.min("_row").alias("_kept")).filter("n > 1"))
    same = shared.select(F.col("doc_id").alias("_id"), F.col("_print").alias("_fp"))
    others = heads.join(same, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_print").eqNullSafe(F.col("_fp")), "left_semi")
    gone = found.filter(~head).unionByName(others.drop("_print")).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_at"))
    kept = shared.select(F.col("doc_id").alias("_id"), F.col("_kept").alias("_at"))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_at"))
    alone = own.join(gone.distinct(), match, "left_anti")
    return alone.unionByName(own.join(kept, match, "left_semi").dropDuplicates(["doc_id", "_row"])).select(*DOCUMENTS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go from the texts; every document stays, even if nothing of it is left."""
    docs = spread(docs)
    left = suffix.remove_repeats(docs, suffix.repeats(docs), carry=["lang", "source"])
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*DOCUMENTS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those it does not take go."""
    sized = spread(docs).select("doc_id", "source", word_count("text").alias("size"))
    mixed = mixing.mix(sized.withColumn("weight", mixing.length_weight(F.col("size"))))
    copies = mixed.groupBy("doc_id").agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    taken = docs.select(*DOCUMENTS).join(copies.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*DOCUMENTS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes."""
    return bpe.digests(bpe.round_trip(spread(docs), vocabulary(), public_tokenizers.PATTERN), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

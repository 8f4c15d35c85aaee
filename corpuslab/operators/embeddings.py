"""Document vectors from word, chunk and feature vectors; categorical and node features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.vectors import doubles, mean_vector
from corpuslab.operators.linked import linked_means
from corpuslab.plans.scale import TEXT_PER_TASK, global_rank

FEATURE_GROUPS = ("struc", "struc+cat", "cat", "struc+emb", "cat+emb", "emb", "all")
#: Text of the documents that meet the vectors of their words in one task.
BLOCK_TEXT = 16 << 20


def mean_word_vectors(
    docs: DataFrame, key: str, text: str, word_vectors: DataFrame, width: int
) -> DataFrame:
    """(key, vec): mean vector over known words, each occurrence counting; zeros if none.

    word_vectors: (word, vec), a row per word. Documents are dealt to blocks by their size and stay there; words are
    counted per document, and a block is sent the vector of each of its words once (``linked``).
    """
    texts = docs.select(F.col(key).alias("target"), text).filter("target is not null")
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, min(math.ceil(total / TEXT_PER_TASK), docs.sparkSession.sparkContext.defaultParallelism), math.ceil(total / BLOCK_TEXT))
    placed = texts.select("*", F.lit(0).alias("_r"), F.pmod(F.xxhash64("target"), F.lit(n)).alias("_c")).repartition(n, "_r", "_c")
    counted = (
        placed.select("target", "_r", "_c", F.explode(tx.words(F.col(text))).alias("source"))
        .groupBy("_r", "_c", "target", "source")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    means = linked_means(counted, word_vectors.withColumnRenamed("word", "source"), 1, n, 0)
    return _or_zeros(docs, means.withColumnRenamed("target", key), key, width)


def _or_zeros(every: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), width)
    return every.select(key).join(vectors, key, "left").select(key, F.coalesce("vec", zero).alias("vec"))


def mean_pool(vectors: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, vec): element-wise mean per group."""
    return vectors.groupBy(*keys).agg(mean_vector(F.col(vec)).alias(vec))


def mean_features(nodes: DataFrame, features: DataFrame, key: str, width: int) -> DataFrame:
    """Mean over the feature vectors a node has, zeros if it has none.

    features: (key, feature, vec), several rows for a chunked feature, which is pooled first.
    """
    pooled = mean_pool(mean_pool(features, [key, "feature"]), [key])
    return _or_zeros(nodes, pooled, key, width)


def lowered_values(single: Sequence[str], multi: Sequence[str]) -> Column:
    """All categorical values of a row, lower-cased, empty and null ones dropped."""
    parts = [F.array(F.lower(c)) for c in single]
    parts += [
        F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower) for c in multi
    ]
    return F.filter(F.concat(*parts), lambda v: v.isNotNull() & (v != ""))


def category_values(nodes: DataFrame, single: Sequence[str], multi: Sequence[str]) -> DataFrame:
    """The categorical dictionary: distinct lower-cased values over all columns."""
    return nodes.select(F.explode(F.array_distinct(lowered_values(single, multi))).alias("value")).distinct()


def category_index(values: DataFrame) -> DataFrame:
    """(value, idx): the dictionary in order, as a table of any size."""
    return global_rank(values, ["value"], name="idx")


def multi_hot(
    nodes: DataFrame, key: str, single: Sequence[str], multi: Sequence[str], index: DataFrame
) -> DataFrame:
    """(key, cat): the sorted positions of a row's values in ``index`` (value, idx), which are the
    ones of its 0/1 vector. A row without values has none."""
    values = nodes.select(key, F.explode(F.array_distinct(lowered_values(single, multi))).alias("value"))
    found = values.join(index, "value").groupBy(key).agg(F.sort_array(F.collect_list("idx")).alias("cat"))
    none = F.array().cast("array<bigint>")
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("cat", none).alias("cat"))


def _shifted(at: int, i: Column) -> Column:
    return (i + F.lit(at)).cast("int")


def node_vector(group: str, n_struc: int, n_cat: int, n_emb: int) -> Column:
    """Chosen feature groups of (struc, cat, emb) in that order as a sparse vector: a struct of size,
    indices and values."""
    if group not in FEATURE_GROUPS:
        raise ValueError(f"feature group must be one of {FEATURE_GROUPS}, not {group!r}")
    widths = {"struc": n_struc, "cat": n_cat, "emb": n_emb}
    indices, values, at = [], [], 0
    for part in ("struc", "cat", "emb") if group == "all" else tuple(group.split("+")):
        if part == "cat":
            indices.append(F.transform("cat", partial(_shifted, at)))
            values.append(F.transform("cat", lambda i: F.lit(1.0)))
        else:
            indices.append(F.sequence(F.lit(at), F.lit(at + widths[part] - 1)))
            values.append(doubles(F.col(part)))
        at += widths[part]
    return F.struct(F.lit(at).alias("size"), F.concat(*indices).alias("indices"), F.concat(*values).alias("values"))

"""Bag of words, TF-IDF and n-gram profiles in long form (key, term, value).

Documents are shuffled once by key as raw text, in as many partitions as their size needs; counting,
limiting and weighting then stay inside that partitioning. Class profiles are counted where the texts lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.plans.scale import compute_once, cut_lineage, global_rank, measured, place_by_size, widen_scan

# How many n-grams of each length a profile keeps.
PROFILE_LIMITS = {1: 100, 2: 30, 3: 30}
KINDS = {"uni": 1, "bi": 2, "tri": 3}
#: Hash buckets that bound the counts of a class's n-grams from above, and how many at most are broadcast.
BUCKETS, MAX_BUCKET_ROWS = 1 << 15, 1 << 20


def bag_of_words(docs: DataFrame, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, term, value) with the term count as value."""
    return (
        place_by_size(docs.select(key, *keep, text), key, text)
        .select(key, *keep, F.explode(tx.terms(F.col(text))).alias("term"))
        .groupBy(key, *keep, "term")
        .agg(F.count("*").cast("double").alias("value"))
    )


def vocabulary(train_terms: DataFrame) -> DataFrame:
    """Distinct training terms with their alphabetical index."""
    return global_rank(train_terms.select("term").distinct(), ["term"], name="idx")


def _spread(rows: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """Rows placed by ``by`` in ``parts`` partitions; Spark's number if there is none."""
    return rows.repartition(parts, *by) if parts else rows


def in_vocabulary(terms: DataFrame, known: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Keep only terms present in ``known(term)``, one row per term."""
    return _spread(terms, parts, "term").join(_spread(known.select("term"), parts, "term"), "term", "left_semi")


def document_frequency(train_terms: DataFrame) -> DataFrame:
    return train_terms.groupBy("term").agg(F.count("*").alias("df"))


def weigh(terms: DataFrame, idf: DataFrame, key: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Counts times idf(by.., term, idf), each document scaled to unit length; terms without
    a training frequency are dropped. ``parts`` is the number of partitions for both joins of the terms."""
    on = [*by, "term"]
    weighted = _spread(terms, parts, *on).join(_spread(idf, parts, *on), on).withColumn(
        "value", F.col("value") * F.col("idf")
    )
    weighted = _spread(weighted, parts, *by, key)
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*by, key)))
    return weighted.withColumn("value", F.try_divide(F.col("value"), length)).select(*terms.columns)


def tfidf(terms: DataFrame, frequency: DataFrame, n_docs: int, key: str, parts: int | None = None) -> DataFrame:
    """Smoothed, length-normalised weights from document frequencies of the training side."""
    idf = frequency.select(
        "term", (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")
    )
    return weigh(terms, idf, key, parts=parts)


def fit_features(
    train: DataFrame, test: DataFrame, key: str, text: str, kind: str = "bow", keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Training and test features over the training vocabulary. Terms meet it in as many partitions as the training
    texts needed, so what a task sorts does not grow with the tables."""
    train_terms = cut_lineage(bag_of_words(train, key, text, keep))  # read twice or more
    test_terms = bag_of_words(test, key, text, keep)
    held = train_terms.rdd.getNumPartitions()
    parts = held if held > int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    if kind == "bow":
        frequency = document_frequency(_spread(train_terms.select("term"), parts, "term"))
        return train_terms, in_vocabulary(test_terms, frequency, key, parts)
    if kind == "tfidf":
        frequency, n = document_frequency(_spread(train_terms, parts, "term")), train.count()
        return tfidf(train_terms, frequency, n, key, parts), tfidf(test_terms, frequency, n, key, parts)
    raise ValueError(f"feature kind must be 'bow' or 'tfidf', not {kind!r}")


def _limit(limits: Mapping[int, int]) -> Column:
    limit = F.lit(0)
    for n, top in limits.items():
        limit = F.when(F.col("n") == n, F.lit(top)).otherwise(limit)
    return limit


def _counted(rows: DataFrame, keys: Sequence[str], limits: Mapping[int, int]) -> DataFrame:
    """Weights over the kept n-grams of every (key, n); ties go to the earliest occurrence."""
    most = Window.partitionBy(*keys, "n").orderBy(F.desc("cnt"), "first")
    of_n = Window.partitionBy(*keys, "n")
    return (
        rows.withColumn("_rn", F.row_number().over(most))
        .filter(F.col("_rn") <= max(limits.values()))
        .filter(F.col("_rn") <= _limit(limits))
        .withColumn("weight", F.try_divide("cnt", F.sum("cnt").over(of_n)))
        .select(*keys, "n", "ngram", "cnt", "weight")
    )


def _exploded(docs: DataFrame, keys: Sequence[str], text: str, lengths: Sequence[int]) -> DataFrame:
    """One row per n-gram; a document without any keeps one row with a null n-gram.

    Words are zipped with their successors once, so the n-grams of a position are built from
    plain columns inside generated code.
    """
    longest = max(lengths)
    shifted = [F.slice("_w", i + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"w{i}") for i in range(longest)]
    placed = compute_once(docs, _w=tx.words(F.col(text))).select(
        *keys, F.posexplode_outer(F.arrays_zip(*shifted)).alias("pos", "_z")
    )

    def gram(n: int) -> Column:
        return F.struct(
            F.lit(n).alias("n"),
            F.concat(*(x for i in range(n) for x in ([F.lit(" ")] if i else []) + [F.col(f"_z.w{i}")])).alias("ngram"),
        )

    return (
        placed.select(*keys, "pos", F.explode(F.array(*(gram(n) for n in lengths))).alias("g"))
        .select(*keys, "pos", "g.*")
        .filter(F.col("ngram").isNotNull() | (F.col("pos").isNull() & (F.col("n") == min(lengths))))
    )


def ngram_profile(
    docs: DataFrame, key: str, text: str, limits: Mapping[int, int] = PROFILE_LIMITS, keep: Sequence[str] = (),
    placed: bool = False,
) -> DataFrame:
    """Top n-grams per document with their share of the kept counts (no further shuffle
    after documents are placed by key). ``keep`` carries columns fixed per row of ``docs``; with
    ``placed`` the rows of a key are already together."""
    chosen = docs.select(key, *keep, text)
    rows = _exploded(chosen if placed else place_by_size(chosen, key, text), [key, *keep], text, list(limits))
    counted = rows.groupBy(key, *keep, "n", "ngram").agg(
        F.count("ngram").alias("cnt"), F.min("pos").alias("first")
    )
    return _counted(counted, [key, *keep], limits)


def class_profile(
    docs: DataFrame,
    label: str,
    key: str,
    text: str,
    limits: Mapping[int, int] = PROFILE_LIMITS,
) -> DataFrame:
    """Top n-grams of each class over all of its texts, ties to the earliest in (key,
    position) order.

    Texts stay where they lie. A first pass counts hash buckets of n-grams, at most ``BUCKETS`` per class and
    length: a bucket's count is an upper bound for each of its n-grams. The fullest buckets are then counted by
    n-gram; their k-th count is what the rest must reach, and every other bucket that reaches it is counted as well.
    So all n-grams that can be in a profile are counted exactly, and the others never leave their task. The limit
    is applied per task before the classes meet, so a dominant class is never in one place.
    """
    texts = widen_scan(docs.select(label, key, text))
    cell = [label, "n", "_bucket"]
    bucket = F.pmod(F.xxhash64("ngram"), F.lit(BUCKETS)).cast("int")
    rows = _exploded(texts, [label, key], text, list(limits)).filter("ngram is not null").withColumn("_bucket", bucket)
    bounds = cut_lineage(rows.groupBy(*cell).agg(F.count("*").alias("most")))
    fullest = Window.partitionBy(label, "n").orderBy(F.desc("most"), "_bucket")
    ranked = cut_lineage(bounds.withColumn("_at", F.row_number().over(fullest)))
    early = F.col("_at") <= 4 * _limit(limits)

    def counted(buckets: DataFrame) -> DataFrame:
        found = rows.join(*_same(measured(buckets.select(*cell), MAX_BUCKET_ROWS), cell), "left_semi")
        return cut_lineage(found.groupBy(label, "n", "ngram").agg(F.count("*").alias("cnt"), F.min(key).alias("_doc")))

    counts = counted(ranked.filter(early))
    order = Window.partitionBy(label, "n").orderBy(F.desc("cnt"))
    last = counts.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") == _limit(limits))
    last = measured(last.select(label, "n", F.col("cnt").alias("_least")))  # a row per class and length
    other, same = _same(last, [label, "n"])
    least = F.coalesce("_least", F.lit(0))
    missed = cut_lineage(ranked.filter(~early).join(other, same, "left").filter(F.col("most") >= least).select(*cell))
    if missed.count():
        counts = counts.unionByName(counted(missed))
    reach = counts.join(other, same, "left").filter(F.col("cnt") >= least).select(label, "n", "ngram", "cnt", "_doc")
    reach = cut_lineage(reach)
    # where they first stand: only the documents that hold a first occurrence are read again
    holders = texts.join(*_same(measured(reach.select(F.col("_doc").alias(key)).distinct(), MAX_BUCKET_ROWS), [key]), "left_semi")
    spots = _exploded(holders, [label, key], text, list(limits)).withColumnRenamed(key, "_doc")
    other, same = _same(spots, [label, "n", "ngram", "_doc"])
    placed = reach.join(other, same).groupBy(label, "n", "ngram", "cnt", "_doc").agg(F.min("pos").alias("_pos"))
    return _counted(placed.withColumn("first", F.struct("_doc", "_pos")).drop("_doc", "_pos"), [label], limits)


def _same(right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` under new names and the condition that it agrees in ``names``, nulls included."""
    other = right.select(*(F.col(c).alias(f"_o_{c}" if c in names else c) for c in right.columns))
    return other, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in names))

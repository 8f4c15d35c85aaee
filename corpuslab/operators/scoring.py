"""Dictionary scores, vector similarity, chunk-score accumulation and votes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.vectors import cosine, doubles, first_max
from corpuslab.operators.corpus import decode_label
from corpuslab.operators.embeddings import mean_pool
from corpuslab.operators.features import KINDS, PROFILE_LIMITS
from corpuslab.plans.scale import compute_once

# The open interval that means a mixed document.
MIXED_BAND = (0.33, 0.67)
SCORE_DIGITS = 12
MAX_PROFILE_ROWS = 1_000_000


def profile_limits(configs: Mapping[str, Sequence[str]]) -> dict[int, int]:
    """The n-gram lengths the configurations use, with their limits."""
    used = {KINDS[kind] for kinds in configs.values() for kind in kinds}
    return {n: top for n, top in PROFILE_LIMITS.items() if n in used}


def dictionary_scores(
    profile: DataFrame,
    key: str,
    class_profiles: DataFrame,
    names: Sequence[str],
    configs: Mapping[str, Sequence[str]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, *keep, config, scores): one score per label in index order, zeros included, for every
    configuration (name -> n-gram kinds) in one pass.

    ``class_profiles`` (label, n, ngram, weight) holds at most sum(PROFILE_LIMITS) rows per
    label and ``names`` is a checked dimension, so its size is bounded and it is broadcast;
    the profile keeps its partitioning by key and the sum needs no shuffle.
    """
    if len(names) * sum(PROFILE_LIMITS.values()) > MAX_PROFILE_ROWS:
        raise ValueError("too many labels for a broadcast class profile")
    wanted = class_profiles.select(
        "n", "ngram", F.col("label").alias("_label"), F.col("weight").alias("_g")
    )
    matched = profile.join(F.broadcast(wanted), ["n", "ngram"], "left")

    def total(name: str, kinds: Sequence[str]) -> Column:
        hit = (F.col("_label") == name) & F.col("n").isin(*(KINDS[k] for k in kinds))
        return F.coalesce(F.sum(F.when(hit, F.col("weight") * F.col("_g"))), F.lit(0.0))

    scored = F.array(
        *(
            F.struct(F.lit(c).alias("config"), F.array(*(total(n, kinds) for n in names)).alias("scores"))
            for c, kinds in configs.items()
        )
    )
    keys = [key, *keep]
    return matched.groupBy(*keys).agg(scored.alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def score_rows(scored: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return scored.select(*keys, F.posexplode("scores").alias("label_idx", "score")).withColumn(
        "label", decode_label(F.col("label_idx"), names)
    )


def predict_lowest(scored: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, yhat): greatest score, ties to the lowest label index (all zeros give label 0)."""
    rounded = F.transform("scores", lambda s: F.round(s, SCORE_DIGITS))
    return scored.select(*keys, decode_label(first_max(rounded), names).alias("yhat"))


def label_similarity(
    vectors: DataFrame, keys: Sequence[str], labels: Column, vec: str = "vec"
) -> DataFrame:
    """(keys, scores): cosine with every label vector, in label order.

    ``labels`` is a constant array<struct<label, vec>> (see inline_table), already sorted.
    """
    own = doubles(F.col(vec))
    return vectors.withColumn("_own", own).withColumn("_labels", labels).select(
        *keys,
        F.transform("_labels", lambda s: cosine(F.col("_own"), doubles(s["vec"]))).alias("scores"),
    )


def similarity_mean(
    chunks: DataFrame, key: str, labels: Column, names: Sequence[str]
) -> DataFrame:
    """Predict from the mean-pooled document vector."""
    return predict_lowest(label_similarity(mean_pool(chunks, [key]), [key], labels), [key], names)


def similarity_first_chunk(
    chunks: DataFrame, key: str, labels: Column, names: Sequence[str]
) -> DataFrame:
    """Predict the label whose list of chunk scores is lexicographically greatest.

    chunks: (key, chunk_pos, vec). Lists are never gathered: of two labels the greater list
    is decided at the first chunk where they differ, a minimum that combines before the
    shuffle, so a document of any number of chunks is spread over tasks.
    """
    scored = label_similarity(chunks, [key, "chunk_pos"], labels)
    rounded = F.transform("scores", lambda s: F.round(s, SCORE_DIGITS))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    duel = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs)))
    met = (
        compute_once(scored, _s=rounded)
        .select(key, "chunk_pos", "_s", duel.alias("d"))
        .withColumn("gap", F.signum(F.get("_s", F.col("d.i")) - F.get("_s", F.col("d.j"))))
        .groupBy(key, "d")
        # null positions are ignored, so only chunks where the two differ are compared
        .agg(F.min_by("gap", F.when(F.col("gap") != 0, F.col("chunk_pos"))).alias("won"))
    )
    loser = F.when(F.col("won") < 0, F.col("d.i")).otherwise(F.col("d.j"))  # equal lists: the later label
    left = F.array_except(F.lit(list(range(len(names)))), F.collect_set(loser))
    return met.groupBy(key).agg(left.alias("_left")).select(
        key, decode_label(F.element_at("_left", 1), names).alias("yhat")
    )


def accumulate_scores(chunk_scores: DataFrame, key: str) -> DataFrame:
    """(key, label, score, first): summed score per label and where the label first appears.

    chunk_scores: (key, chunk_pos, label_pos, label, score); null scores do not count.
    """
    return (
        chunk_scores.filter(F.col("score").isNotNull())
        .groupBy(key, "label")
        .agg(F.sum("score").alias("score"), F.min(F.struct("chunk_pos", "label_pos")).alias("first"))
    )


def count_votes(answers: DataFrame, key: str) -> DataFrame:
    """The same shape from chunk answers (key, chunk_pos, label)."""
    votes = answers.withColumn("label_pos", F.lit(0)).withColumn("score", F.lit(1.0))
    return accumulate_scores(votes, key)


def normalise_scores(totals: DataFrame, key: str) -> DataFrame:
    return totals.withColumn("share", F.try_divide("score", F.sum("score").over(Window.partitionBy(key))))


def decide(
    totals: DataFrame, key: str, mixed: str | None = None, band: tuple[float, float] = MIXED_BAND
) -> DataFrame:
    """(key, yhat) from accumulated scores: with ``mixed``, any share strictly inside the band
    gives that label; otherwise the greatest score, ties to the label seen first."""
    rank = F.struct(
        F.round("score", SCORE_DIGITS).alias("score"),
        (-F.col("first.chunk_pos")).alias("chunk"),
        (-F.col("first.label_pos")).alias("label"),
    )
    per_doc = totals.groupBy(key).agg(
        F.max_by("label", rank).alias("best"),
        F.sum("score").alias("total"),
        F.collect_list("score").alias("all"),
    )
    answer = F.col("best")
    if mixed is not None:
        low, high = band
        share = lambda s: F.try_divide(s, F.col("total"))
        inside = F.exists("all", lambda s: (share(s) > F.lit(low)) & (share(s) < F.lit(high)))
        answer = F.when(inside, F.lit(mixed)).otherwise(answer)
    return per_doc.select(key, answer.alias("yhat"))


def skipped(docs: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Documents without any surviving score; they leave the evaluation."""
    return docs.join(decided.select(key), key, "left_anti")


def entailment_scores(logits: DataFrame, score: Column) -> DataFrame:
    """logits (key.., label_pos, label) with ``score`` null where neutral wins, dropped here."""
    return logits.withColumn("score", score).filter(F.col("score").isNotNull())

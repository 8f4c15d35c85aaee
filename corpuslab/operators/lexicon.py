"""Part-of-speech filter and lemmas as joins with a lexicon(word, pos, lemma) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx


def lemmatise(
    docs: DataFrame,
    key: str,
    tokens: str,
    lexicon: DataFrame,
    removed_tags: Sequence[str] | None = tx.REMOVED_TAGS,
) -> DataFrame:
    """(key, text): tokens whose tag is kept, as lemmas, in order, joined by a space.

    Positions are folded per (document, word) before the join, so a word crosses the network
    once per document, and only kept words come back, a word with its positions. A word with several lexicon rows stays if one of its tags does, with the
    lemma of the first such tag. Without ``removed_tags`` tokens pass through unchanged.
    """
    if removed_tags is None:
        return docs.select(key, F.array_join(tokens, " ").alias("text"))
    placed = (
        docs.select(key, tokens)
        .repartition(key)
        .select(key, F.posexplode_outer(tokens).alias("pos", "word"))
        .groupBy(key, "word")
        .agg(F.collect_list("pos").alias("at"))
    )
    dropping = F.coalesce(F.col("pos").isin(*removed_tags), F.lit(False))
    entry = lexicon.groupBy("word").agg(F.min(F.struct(dropping.alias("gone"), "pos", "lemma")).alias("e"))
    tagged = placed.join(entry.select("word", "e.gone", "e.lemma"), "word", "left")
    dropped = F.coalesce(F.col("gone") | F.col("word").isNull(), F.lit(False))
    first = F.array_contains("at", 0) | F.col("word").isNull()  # of what goes, one row keeps a document without a word left
    spots = F.when(~dropped, F.struct("at", F.coalesce("lemma", "word").alias("w")))
    placed_words = F.transform("s", lambda e: F.transform(e["at"], lambda p: F.struct(p.alias("p"), e["w"].alias("w"))))
    return (
        tagged.filter(~dropped | first)
        .select(key, spots.alias("spots"))
        .groupBy(key)
        .agg(F.collect_list("spots").alias("s"))
        .withColumn("kept", F.sort_array(F.flatten(placed_words)))
        .select(key, F.array_join("kept.w", " ").alias("text"))
    )

"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import corpus
from corpuslab.operators.splits import stratified_splits
from corpuslab.plans.scale import TEXT_PER_TASK, place_by_size, widen_scan

SECTION_KEYWORDS = ["The", "En", "Der", "Ertion", "Est", "Lasción"]
NOISE_WORDS = ["the", "and", "les", "und", "del", "que"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): the class is the language."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def wide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen_scan(documents(spark, sf_dir))


def sectioned(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """(doc_id, label, title, abstract, sections): the first line is the abstract, each
    further line a section named by its first word; the title is the source. ``placed`` puts
    documents together by id before they grow."""
    lines = F.split("text", "\n")
    sections = F.transform(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda s: F.struct(F.regexp_extract(s, r"^[^ ]+", 0).alias("name"), s.alias("text")),
    )
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "lang", "source", "text")
    docs = place_by_size(docs, "doc_id", "text", TEXT_PER_TASK // 2) if placed else widen_scan(docs)  # the views repeat the text
    return docs.select(
        "doc_id", F.col("lang").alias("label"), F.col("source").alias("title"),
        F.element_at(lines, 1).alias("abstract"), sections.alias("sections"),
    )


def prepared(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    return corpus.flatten_sections(sectioned(spark, sf_dir, placed))


def first_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test documents of split 0."""
    docs = stratified_splits(documents(spark, sf_dir), "doc_id", "label", n_splits=1)
    train, test = (docs.filter(F.col("role") == r).drop("split", "role") for r in ("train", "test"))
    return train, test


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (doc_id, word) of lower-cased words."""
    docs = wide_documents(spark, sf_dir)
    return docs.select("doc_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("word"))


def top_words(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The n words in most documents, ties by word (a top-k)."""
    counts = word_rows(spark, sf_dir).groupBy("word").agg(F.count("*").alias("df"))
    return counts.orderBy(F.desc("df"), "word").limit(n)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, pos, lemma) of every distinct word, tagged by word length."""
    words = word_rows(spark, sf_dir).select("word").distinct()
    rest = F.length("word") % 5
    return words.select(
        "word",
        F.when(rest == 0, "ADV").when(rest == 1, "NUM").otherwise("NOUN").alias("pos"),
        F.regexp_replace("word", "s$", "").alias("lemma"),
    )


def long_words(text: Column) -> Column:
    """Stand-in frames of a text: its words of 8 or more characters, cut after the fourth."""
    chosen = F.filter(tx.words(text), lambda w: F.length(w) >= 8)
    return F.transform(chosen, lambda w: F.concat(F.substring(w, 1, 4), F.lit("_"), F.substr(w, F.lit(5))))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_pos, frame_pos, frame)."""
    docs = wide_documents(spark, sf_dir)
    sents = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_pos", "s"))
    return sents.select("doc_id", "sent_pos", F.posexplode(long_words(F.col("s"))).alias("frame_pos", "frame"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_pos, vec, label): five consecutive vectors form a document."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("long").alias("doc_id"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("string").alias("label"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst): a part cites its suppliers' numbers as items of the same key space."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, publisher, type, subject) from the parts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("publisher"),
        F.col("p_type").alias("type"), F.split("p_name", " ").alias("subject"),
    )

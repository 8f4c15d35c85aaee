"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import standins as st
from corpuslab.catalog.text_queries import WORDS
from corpuslab.functions import text as tx
from corpuslab.operators import chunks, corpus

LABEL_MAP = {"en": "English", "fr": "French"}


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.class_counts(st.documents(spark, sf_dir))


def keys_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keys_by_class(st.documents(spark, sf_dir), "doc_id", "label", "doc_id")


def balance_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_per_class(st.documents(spark, sf_dir), "label", "doc_id", 19)


def rekey_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies share a key."""
    docs = st.table(spark, sf_dir, "documents").select(F.md5("text").alias("doi"), "doc_id", "source", "lang")
    again = docs.select("doi", F.col("doc_id").alias("seq"), F.col("doc_id").alias("file_name"), "source", F.col("lang").alias("label"))
    return corpus.rekey(again, "doi", "seq")


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.documents(spark, sf_dir)
    names = corpus.label_names(docs)
    coded = docs.select("doc_id", corpus.encode_label(F.col("label"), names).alias("idx"))
    return coded.select("doc_id", F.col("idx").cast("long").alias("idx"), corpus.decode_label(F.col("idx"), names).alias("label"))


def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.documents(spark, sf_dir).select("doc_id", "label")
    return corpus.rewrite_labels(docs, "label", LABEL_MAP)


def section_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = corpus.assemble(
        st.sectioned(spark, sf_dir), "doc_id", "label", "title", st.lexicon(spark, sf_dir), st.NOISE_WORDS)
    return done.select("id", "title", "abstract", "full_text", F.array_join("section_names", "|").alias("names"), "label")


def sections_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.section_rows(st.prepared(spark, sf_dir), "doc_id")
    return rows.withColumn("pos", F.col("pos").cast("long"))


def imp_sections_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = corpus.important_text(st.prepared(spark, sf_dir), st.SECTION_KEYWORDS)
    return done.select("doc_id", "important_text")


def imp_sections_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = corpus.important_text(st.prepared(spark, sf_dir), st.SECTION_KEYWORDS, once=True)
    return done.select("doc_id", "important_text")


FRAME_VIEWS = ("abstract", "full_text", "sec-text")


def frame_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text views of frames: the frames of a view's words, as words."""
    frames = F.transform(st.long_words(tx.strip_marks(F.col("text"))), tx.frame_words)
    chosen = corpus_views(spark, sf_dir).filter(F.col("data_type").isin(*FRAME_VIEWS))
    return chosen.withColumn("text", F.array_join(frames, " "))


def corpus_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.view_rows(st.prepared(spark, sf_dir), "doc_id", keywords=st.SECTION_KEYWORDS)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.titles(st.sectioned(spark, sf_dir), "doc_id")


def label_text_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class descriptions (the balanced documents of each class) through the whole preparation."""
    chosen = corpus.first_per_class(st.documents(spark, sf_dir), "label", "doc_id", 19)
    done = corpus.prepare_text(chosen, "doc_id", "text", st.lexicon(spark, sf_dir), st.NOISE_WORDS)
    return done.join(chosen.select("doc_id", "label"), "doc_id").select("doc_id", "label", "text")


def frame_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = st.sectioned(spark, sf_dir).select("doc_id", "sections")
    found = F.transform(
        "sections", lambda s, i: F.struct(i.alias("sec_pos"), st.long_words(s["text"]).alias("frames"))
    )
    frames = docs.select("doc_id", F.filter(found, lambda f: F.size(f["frames"]) > 0).alias("sec_frames"))
    rows = corpus.align_sections(docs, frames, "doc_id")
    return rows.select(
        "doc_id", F.col("sec_pos").cast("long").alias("sec_pos"), "name", F.array_join("frames", " ").alias("frames")
    )


def strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame text with sentence and section marks, then without them."""
    docs = st.prepared(spark, sf_dir).select("doc_id", F.replace("full_text", F.lit(". "), F.lit(". STB ")).alias("t"))
    return docs.select("doc_id", tx.strip_marks(F.col("t")).alias("frame_text"))


def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.word_chunk_rows(st.wide_documents(spark, sf_dir), ["doc_id", "label"], "text", 32)
    return rows.groupBy("label").agg(F.count("*").alias("n_chunks"))


CLEAN = "regexp_replace(lower({0}), '([(\\[])[^\\n]*?([)\\]])', '\\1\\2', 'g')"
PREP = f"""
lines AS (SELECT doc_id, lang AS label, source AS title, string_split(text, chr(10)) AS l FROM documents),
secs AS (SELECT doc_id, unnest(l[2:]) AS text, generate_subscripts(l[2:], 1) AS pos FROM lines),
named AS (SELECT doc_id, pos, regexp_extract(text, '^[^ ]+') AS name, text FROM secs),
grouped AS (SELECT doc_id, string_agg(' SBA ' || {CLEAN.format('text')}, '' ORDER BY pos) AS tail,
            list(name ORDER BY pos) AS names FROM named WHERE text <> '' GROUP BY doc_id),
prep AS (SELECT lines.doc_id, label, title, l[1] AS abstract, {CLEAN.format('l[1]')} || coalesce(tail, '') AS full_text,
         list_concat(['Abstract'], coalesce(names, [])) AS names FROM lines LEFT JOIN grouped USING (doc_id)),
parts AS (SELECT doc_id, names, string_split(full_text, 'SBA') AS parts FROM prep),
pairs AS (SELECT doc_id, unnest(names) AS name, unnest(parts) AS text, generate_subscripts(parts, 1) AS p FROM parts),
texts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) - 1 AS pos, name, max_by(text, p) AS text
          FROM pairs WHERE name IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, name)"""
KEYWORDS = "(VALUES " + ", ".join(f"('{k}')" for k in st.SECTION_KEYWORDS) + ") AS k(word)"
IMPORTANT = (
    "SELECT d.doc_id, coalesce(t.important_text, '') AS important_text FROM documents d LEFT JOIN ("
    "SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS important_text FROM {0} GROUP BY doc_id) t USING (doc_id)"
)
MULTI = f"(SELECT doc_id, pos, text FROM texts JOIN {KEYWORDS} ON contains(word, name) OR contains(name, word))"
ONCE = f"(SELECT DISTINCT doc_id, pos, text FROM texts JOIN {KEYWORDS} ON contains(word, name) OR contains(name, word))"
VIEWS = f"""
imp AS ({IMPORTANT.format(MULTI)}),
views AS (
  SELECT doc_id, label, 'abstract' AS data_type, split_part(full_text, 'SBA', 1) AS text FROM prep
  UNION ALL SELECT doc_id, label, 'full_text', replace(full_text, 'SBA', ' ') FROM prep
  UNION ALL SELECT doc_id, label, 'sec-name', array_to_string(names, ' ') FROM prep
  UNION ALL SELECT doc_id, label, 'sec-text', important_text FROM prep JOIN imp USING (doc_id))"""

STOPPED = ", ".join(f"'{w}'" for w in st.NOISE_WORDS)
PREPARED = (
    "array_to_string(list_transform(list_filter(" + WORDS + f", lambda w: w NOT IN ({STOPPED}) AND regexp_full_match(w, '\\p{{{{L}}}}+')"
    " AND length(w) % 5 > 1), lambda w: regexp_replace(w, 's$', '')), ' ')")

FRAME_TEXT = (
    "array_to_string(list_transform(list_filter(" + WORDS.format("replace(text, 'STB', '')")
    + ", lambda w: length(w) >= 8), lambda w: replace(w[:4] || ' ' || w[5:], '_', ' ')), ' ')")

QUERIES = {
    "class_counts": class_counts,
    "keys_by_class": keys_by_class,
    "balance_topn": balance_topn,
    "rekey_last_wins": rekey_last_wins,
    "label_index": label_index,
    "label_remap": label_remap,
    "section_flatten": section_flatten,
    "sections_explode": sections_explode,
    "imp_sections_multi": imp_sections_multi,
    "imp_sections_once": imp_sections_once,
    "corpus_views": corpus_views,
    "titles": titles,
    "label_text_prepare": label_text_prepare,
    "frame_align": frame_align,
    "strip_marks": strip_marks,
    "chunk_labels": chunk_labels,
}

ORACLE = {
    "class_counts": "SELECT lang AS label, count(*) AS n_docs FROM documents GROUP BY lang",
    "keys_by_class": "SELECT lang AS label, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS at FROM documents",
    "balance_topn": "SELECT doc_id, text, lang AS label FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 19",
    "rekey_last_wins": """
SELECT md5(text) AS doi, min(doc_id) AS seq, max(doc_id) AS file_name, max_by(source, doc_id) AS source,
       max_by(lang, doc_id) AS label FROM documents GROUP BY md5(text)""",
    "label_index": "SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS idx, lang AS label FROM documents",
    "label_remap": "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS label FROM documents",
    "section_flatten": f"""WITH {PREP} SELECT doc_id AS id, title, abstract, {PREPARED.format('full_text')} AS full_text,
  array_to_string(names, '|') AS names, label FROM prep""",
    "sections_explode": f"WITH {PREP} SELECT doc_id, pos, name, text FROM texts",
    "imp_sections_multi": f"WITH {PREP} {IMPORTANT.format(MULTI)}",
    "imp_sections_once": f"WITH {PREP} {IMPORTANT.format(ONCE)}",
    "corpus_views": f"WITH {PREP}, {VIEWS} SELECT doc_id, label, data_type, text FROM views",
    "titles": "SELECT doc_id, source AS title FROM documents",
    "label_text_prepare": f"""
SELECT doc_id, lang AS label, {PREPARED.format(CLEAN.format('text'))} AS text
FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 19""",
    "frame_align": f"""
SELECT doc_id, pos - 1 AS sec_pos, name, frames FROM (
  SELECT doc_id, pos, regexp_extract(text, '^[^ ]+') AS name, text, array_to_string(list_transform(list_filter(
    {WORDS.format('text')}, lambda w: length(w) >= 8), lambda w: w[:4] || '_' || w[5:]), ' ') AS frames
  FROM (SELECT doc_id, unnest(l[2:]) AS text, generate_subscripts(l[2:], 1) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE text <> '' AND frames <> ''""",
    "strip_marks": f"WITH {PREP} SELECT doc_id, replace(replace(replace(full_text, '. ', '. STB '), 'SBA', ''), 'STB', '') AS frame_text FROM prep",
    "chunk_labels": f"""
SELECT lang AS label, sum(CAST(ceil(len({WORDS.format('text')}) / 32) AS BIGINT))::BIGINT AS n_chunks FROM documents GROUP BY lang""",
}

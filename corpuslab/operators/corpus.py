"""Corpus preparation. A document row carries its sections as an ordered
array<struct<name, text>>, so sectioning needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import lexicon
from corpuslab.plans.scale import bounded_rows, compute_once, global_rank

# The section keywords.
IMPORTANT_SECTIONS = [
    "Introduction", "Methodology", "Conclusion", "Conclusions", "Discussion",
    "Results", "Concluding remarks", "Method", "Data",
]
# The merged-class spelling.
MIXED_LABEL = {"Mixed": "Qualitative and Quantitative"}

DATA_TYPES = ("abstract", "full_text", "sec-name", "sec-text")


def class_counts(docs: DataFrame, label: str = "label") -> DataFrame:
    return docs.groupBy(label).agg(F.count("*").alias("n_docs"))


def keys_by_class(docs: DataFrame, key: str, label: str, seq: str) -> DataFrame:
    """(label, key, at): document keys with their place inside their class, in input order, as rows:
    no class is gathered in one list."""
    return global_rank(docs.select(label, key, seq) if key != seq else docs.select(label, key), [seq], within=[label], name="at").select(
        label, key, "at")


def first_per_class(docs: DataFrame, label: str, seq: str, n: int = 19) -> DataFrame:
    """The first n documents of each class in input order (limited before the shuffle)."""
    in_class = Window.partitionBy(label).orderBy(seq)
    return docs.withColumn("_rn", F.row_number().over(in_class)).filter(F.col("_rn") <= n).drop("_rn")


def rekey(docs: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the last occurrence's values at the first occurrence's position."""
    values = [c for c in docs.columns if c not in (key, seq)]
    return (
        docs.groupBy(key)
        .agg(F.max_by(F.struct(*values), F.col(seq)).alias("v"), F.min(seq).alias(seq))
        .select(key, seq, "v.*")
    )


def flatten_sections(
    docs: DataFrame,
    abstract: str = "abstract",
    sections: str = "sections",
    clean: Callable[[Column], Column] = tx.normalise,
) -> DataFrame:
    """Adds full_text (abstract and non-empty sections joined by the section mark) and
    section_names ('Abstract' first, then the names of non-empty sections). A null abstract counts
    as empty, so names and texts stay side by side."""
    kept = F.filter(sections, lambda s: s["text"].isNotNull() & (s["text"] != ""))
    return (
        docs.withColumn("_kept", kept)
        .withColumn(
            "full_text",
            F.array_join(
                F.concat(
                    F.array(F.coalesce(clean(F.col(abstract)), F.lit(""))),
                    F.transform("_kept", lambda s: clean(s["text"])),
                ),
                f" {tx.SECTION_MARK} ",
            ),
        )
        .withColumn(
            "section_names",
            F.concat(F.array(F.lit("Abstract")), F.transform("_kept", lambda s: s["name"])),
        )
        .drop("_kept")
    )


def prepare_text(
    docs: DataFrame, key: str, text: str, words: DataFrame, stop: Sequence[str] = (), noise: Sequence[str] = (),
    removed_tags: Sequence[str] | None = tx.REMOVED_TAGS,
) -> DataFrame:
    """(key, text): the whole preparation in one operator: lower case, brackets, noise words, stop words,
    alphabetic words, part-of-speech filter and lemmas from the lexicon ``words``. Section marks are
    alphabetic words that no lexicon holds, so they stay."""
    marked = F.split(F.col(text), tx.SECTION_MARK)
    cleaned = F.array_join(F.transform(marked, lambda t: tx.normalise(t, noise=noise)), f" {tx.SECTION_MARK} ")
    tokens = tx.keep_alphabetic(tx.drop_stop_words(tx.words(cleaned), stop))
    return lexicon.lemmatise(docs.select(key, tokens.alias("tokens")), key, "tokens", words, removed_tags)


def assemble(
    docs: DataFrame, key: str, label: str, title: str, words: DataFrame, stop: Sequence[str] = (),
) -> DataFrame:
    """The prepared columnar dataset from a balanced, sectioned corpus, with fully prepared texts."""
    flat = flatten_sections(docs)
    prepared = prepare_text(flat, key, "full_text", words, stop)
    return flat.drop("full_text").join(prepared.withColumnRenamed("text", "full_text"), key).select(
        F.col(key).alias("id"), F.col(title).alias("title"), "abstract", "full_text",
        "section_names", F.col(label).alias("label"),
    )


def with_section_texts(prepared: DataFrame) -> DataFrame:
    """Adds section_texts: names zipped with the split full text (the shorter side decides);
    a repeated name keeps its first position and its last text."""
    parts = F.split("full_text", tx.SECTION_MARK)
    pairs = F.slice(
        F.arrays_zip(F.col("section_names").alias("name"), parts.alias("text")),
        F.lit(1),
        F.least(F.size("section_names"), F.size(parts)),
    )
    base = compute_once(prepared, _pairs=pairs)
    return base.withColumn(
        "section_texts",
        F.transform(
            F.array_distinct("_pairs.name"),
            lambda n: F.struct(
                n.alias("name"),
                F.element_at(F.filter("_pairs", lambda p: p["name"] == n), -1)["text"].alias("text"),
            ),
        ),
    ).drop("_pairs")


def section_rows(prepared: DataFrame, key: str) -> DataFrame:
    return (
        with_section_texts(prepared)
        .select(key, F.posexplode("section_texts").alias("pos", "s"))
        .select(key, "pos", F.col("s.name").alias("name"), F.col("s.text").alias("text"))
    )


def keyword_hits(name: Column, keywords: Sequence[str]) -> Column:
    """How many keywords contain the name or are contained in it."""
    hits = F.lit(0)
    for word in keywords:
        hits = hits + (F.lit(word).contains(name) | name.contains(F.lit(word))).cast("int")
    return hits


def important_text(
    prepared: DataFrame, keywords: Sequence[str] = IMPORTANT_SECTIONS, once: bool = False
) -> DataFrame:
    """Adds important_text: matching sections joined by a space, each as often as keywords
    match its name, or once."""
    def copies(s: Column) -> Column:
        hits = keyword_hits(s["name"], keywords)
        return F.array_repeat(s["text"], F.least(hits, F.lit(1)) if once else hits)

    return with_section_texts(prepared).withColumn(
        "important_text",
        F.array_join(F.flatten(F.transform("section_texts", copies)), " "),
    )


def abstract_text(kind: str = "raw") -> Column:
    if kind == "raw":
        return F.col("abstract")
    if kind == "clean":
        return F.substring_index("full_text", tx.SECTION_MARK, 1)
    raise ValueError(f"abstract kind must be 'raw' or 'clean', not {kind!r}")


def joined_text() -> Column:
    return F.replace("full_text", F.lit(tx.SECTION_MARK), F.lit(" "))


def section_name_view(kind: str = "unit") -> Column:
    if kind == "unit":
        return F.col("section_names")
    if kind == "seq":
        return F.array_join("section_names", " ")
    raise ValueError(f"section name kind must be 'unit' or 'seq', not {kind!r}")


def titles(prepared: DataFrame, key: str) -> DataFrame:
    return prepared.select(key, "title")


def corpus_view(
    prepared: DataFrame,
    key: str,
    data_type: str,
    label_names: Sequence[str] | None = None,
    keywords: Sequence[str] = IMPORTANT_SECTIONS,
) -> DataFrame:
    """(key, text, label) for one of the four text views; labels as indexes when
    ``label_names`` is given."""
    if data_type not in DATA_TYPES:
        raise ValueError(f"data type must be one of {DATA_TYPES}, not {data_type!r}")
    if data_type == "sec-text":
        prepared = important_text(prepared, keywords)
        text = F.col("important_text")
    else:
        text = {
            "abstract": abstract_text("clean"),
            "full_text": joined_text(),
            "sec-name": section_name_view("seq"),
        }[data_type]
    label = F.col("label") if label_names is None else encode_label(F.col("label"), label_names)
    return prepared.select(key, text.alias("text"), label.alias("label"))


def view_rows(
    prepared: DataFrame, key: str, label_names: Sequence[str] | None = None, keywords: Sequence[str] = IMPORTANT_SECTIONS,
) -> DataFrame:
    """(key, data_type, text, label) of all four text views from one scan, a row per view; rows stay where
    their document is."""
    label = F.col("label") if label_names is None else encode_label(F.col("label"), label_names)
    texts = {
        "abstract": abstract_text("clean"), "full_text": joined_text(), "sec-name": section_name_view("seq"),
        "sec-text": F.col("important_text"),
    }
    views = F.array(*(F.struct(F.lit(kind).alias("data_type"), texts[kind].alias("text")) for kind in DATA_TYPES))
    return important_text(prepared, keywords).select(key, label.alias("label"), F.explode(views).alias("v")).select(
        key, "v.data_type", "v.text", "label")


def rewrite_labels(docs: DataFrame, label: str, mapping: Mapping[str, str] = MIXED_LABEL) -> DataFrame:
    return docs.withColumn(label, tx.remap(F.col(label), mapping))


def label_names(docs: DataFrame, label: str = "label", limit: int = 1000) -> list:
    """Sorted distinct labels; classes are a bounded dimension and the bound is checked."""
    return sorted(row[0] for row in bounded_rows(docs.select(label).distinct(), limit))


def encode_label(label: Column, names: Sequence[str]) -> Column:
    return (F.array_position(F.lit(list(names)), label) - 1).cast("int")


def decode_label(index: Column, names: Sequence[str]) -> Column:
    return F.try_element_at(F.lit(list(names)), (index + 1).cast("int"))


def align_sections(texts: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Sections paired with their frame lists by (document, position). A pair with an empty
    text or no frames is skipped.

    texts: (key, sections array<struct<name, text>>); frames: (key, sec_frames
    array<struct<sec_pos, frames>>), one row per document each.
    """
    paired = compute_once(texts.join(frames, key), _frames=F.map_from_entries(F.transform(
        "sec_frames", lambda f: F.struct(f["sec_pos"].alias("k"), f["frames"].alias("v"))))).withColumn(
        "_pair",
        F.explode(
            F.transform(
                "sections",
                lambda s, i: F.struct(
                    i.alias("sec_pos"),
                    s["name"].alias("name"),
                    s["text"].alias("text"),
                    F.try_element_at("_frames", i).alias("frames"),
                ),
            )
        ),
    )
    return paired.filter((F.col("_pair.text") != "") & (F.size("_pair.frames") > 0)).select(
        key, "_pair.*"
    )

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import corpus

SECTIONS = "array<struct<name:string,text:string>>"


def prepared(spark, sections, abstract="Abs (x)"):
    df = spark.createDataFrame([(1, "A", abstract, sections)], f"id int, label string, abstract string, sections {SECTIONS}")
    return corpus.flatten_sections(df)


def test_flatten_skips_empty_sections(spark):
    row = prepared(spark, [("One", "T1"), ("Two", ""), ("Three", None), ("Four", "T4")]).first()
    assert row.full_text == "abs () SBA t1 SBA t4"
    assert row.section_names == ["Abstract", "One", "Four"]


def test_repeated_section_keeps_last_text_at_first_position(spark):
    rows = corpus.section_rows(prepared(spark, [("X", "first"), ("Y", "mid"), ("X", "last")]), "id").orderBy("pos").collect()
    assert [(r.pos, r.name, r.text.strip()) for r in rows] == [(0, "Abstract", "abs ()"), (1, "X", "last"), (2, "Y", "mid")]


def test_zip_stops_at_the_shorter_side(spark):
    df = spark.createDataFrame([(1, "a SBA b SBA c", ["N1", "N2"])], "id int, full_text string, section_names array<string>")
    assert [r.name for r in corpus.section_rows(df, "id").collect()] == ["N1", "N2"]


def test_important_sections_multiplicity_and_once(spark):
    df = spark.createDataFrame(
        [(1, "a SBA b SBA c SBA d", ["Introduction", "Data and Methodology", "Conclusions", "Annex"])],
        "id int, full_text string, section_names array<string>",
    )
    many = corpus.important_text(df).first().important_text.split()
    once = corpus.important_text(df, once=True).first().important_text.split()
    assert many == "a b b b c c".split()
    assert once == "a b c".split()


def test_an_empty_name_matches_every_keyword(spark):
    df = spark.createDataFrame([(1, "a", [""])], "id int, full_text string, section_names array<string>")
    assert corpus.important_text(df).first().important_text.split() == ["a"] * 9


def test_views(spark):
    df = prepared(spark, [("Results", "R1"), ("Annex", "X")])
    text = {k: corpus.corpus_view(df, "id", k).first().text.split() for k in corpus.DATA_TYPES}
    assert text == {
        "abstract": ["abs", "()"], "full_text": ["abs", "()", "r1", "x"],
        "sec-name": ["Abstract", "Results", "Annex"], "sec-text": ["r1"],
    }
    assert corpus.corpus_view(df, "id", "abstract", ["A", "B"]).first().label == 0
    with pytest.raises(ValueError):
        corpus.corpus_view(df, "id", "body")
    with pytest.raises(ValueError):
        corpus.abstract_text("dirty")
    with pytest.raises(ValueError):
        corpus.section_name_view("list")


def test_balance_takes_the_first_of_each_class(spark):
    rows = [(i, "AB"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "seq int, label string")
    got = sorted(r.seq for r in corpus.first_per_class(df, "label", "seq", 3).collect())
    assert got == [0, 1, 2, 3, 4, 5]


def test_rekey_last_value_first_position(spark):
    df = spark.createDataFrame([("k", 0, "a"), ("m", 1, "b"), ("k", 2, "c")], "doi string, seq int, title string")
    got = {r.doi: (r.seq, r.title) for r in corpus.rekey(df, "doi", "seq").collect()}
    assert got == {"k": (0, "c"), "m": (1, "b")}


def test_labels(spark):
    df = spark.createDataFrame([("Mixed",), ("Quantitative",), ("Qualitative",)], "label string")
    mapped = corpus.rewrite_labels(df, "label")
    names = corpus.label_names(mapped)
    assert names == ["Qualitative", "Qualitative and Quantitative", "Quantitative"]
    coded = mapped.select("label", corpus.encode_label(F.col("label"), names).alias("i"))
    assert {r.label: r.i for r in coded.collect()} == {n: i for i, n in enumerate(names)}
    back = coded.select("label", corpus.decode_label(F.col("i"), names).alias("b")).collect()
    assert all(r.label == r.b for r in back)
    with pytest.raises(ValueError):
        corpus.label_names(mapped, limit=2)


def test_alignment_skips_empty_text_and_missing_frames(spark):
    texts = spark.createDataFrame([(1, [("A", "x"), ("B", ""), ("C", "z"), ("D", "w")])], f"id int, sections {SECTIONS}")
    frames = spark.createDataFrame(
        [(1, [(0, ["F"]), (1, ["G"]), (3, [])])], "id int, sec_frames array<struct<sec_pos:int,frames:array<string>>>"
    )
    rows = corpus.align_sections(texts, frames, "id").collect()
    assert [(r.sec_pos, r.name, r.frames) for r in rows] == [(0, "A", ["F"])]


def test_null_abstract_keeps_names_and_texts_together(spark):
    rows = spark.createDataFrame([(1, None, [("S1", "x"), ("S2", "y")])], "id int, abstract string, sections array<struct<name:string,text:string>>")
    done = corpus.section_rows(corpus.flatten_sections(rows), "id").collect()
    assert [(r.name, r.text.strip()) for r in done] == [("Abstract", ""), ("S1", "x"), ("S2", "y")]


def test_text_preparation_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "The Cats (all) run SBA quickly, the dogs 12"), (2, None)], "id int, t string")
    words = spark.createDataFrame([("cats", "NOUN", "cat"), ("run", "VERB", "run"), ("dogs", "NOUN", "dog")], "word string, pos string, lemma string")
    got = {r.id: r.text for r in corpus.prepare_text(docs, "id", "t", words, stop=["the"]).collect()}
    assert got == {1: "cat run SBA dog", 2: ""}

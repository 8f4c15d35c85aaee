import math

from pyspark.sql import functions as F

from corpuslab.functions import vectors
from corpuslab.operators import features, scoring

NAMES = ["Mix", "Qual", "Quan"]


def test_all_zero_scores_give_the_first_label(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0])], "id int, scores array<double>")
    assert {r.id: r.yhat for r in scoring.predict_lowest(df, ["id"], NAMES).collect()} == {1: "Mix", 2: "Qual"}


def test_dictionary_scores(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "")], "id int, t string")
    texts = spark.createDataFrame([("P", 0, "a c"), ("Q", 0, "d")], "label string, k int, t string")
    scored = scoring.dictionary_scores(
        features.ngram_profile(docs, "id", "t"), "id", features.class_profile(texts, "label", "k", "t"),
        ["P", "Q"], {"uni": ["uni"], "all": ["uni", "bi"]},
    )
    got = {(r.id, r.config): [round(x, 6) for x in r.scores] for r in scored.collect()}
    assert got[(1, "uni")] == [round(2 / 3 * 0.5, 6), 0.0]
    assert got[(2, "all")] == [0.0, 0.0]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    row = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert math.isclose(row.x, 0.96) and row.y == 0.0


def test_first_chunk_decides_and_later_chunks_break_ties(spark):
    # unit label vectors make a chunk's scores its normalised coordinates
    labels = F.from_json(
        F.lit('[{"label":"Mix","vec":[1.0,0.0,0.0]},{"label":"Qual","vec":[0.0,1.0,0.0]},{"label":"Quan","vec":[0.0,0.0,1.0]}]'),
        "array<struct<label:string,vec:array<double>>>",
    )
    df = spark.createDataFrame(
        [(1, 0, [0.3, 0.2, 0.3]), (1, 1, [0.1, 0.9, 0.05]), (2, 0, [1.0, 1.0, 1.0])], "id int, chunk_pos int, vec array<double>"
    )
    got = {r.id: r.yhat for r in scoring.similarity_first_chunk(df, "id", labels, NAMES).collect()}
    assert got == {1: "Mix", 2: "Mix"}
    mean = {r.id: r.yhat for r in scoring.similarity_mean(df, "id", labels, NAMES).collect()}
    assert mean[1] == "Qual"


def test_entailment_drops_neutral(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0), (0.0, 1.0, 2.0), (0.0, 0.0, 0.0)], "c double, n double, e double")
    got = [r.s for r in df.select(vectors.entailment(F.col("c"), F.col("n"), F.col("e")).alias("s")).collect()]
    assert got[0] is None and math.isclose(got[1], math.exp(2) / (1 + math.exp(2))) and got[2] == 0.5


def votes(spark, *answers):
    return scoring.count_votes(spark.createDataFrame(list(answers), "id int, chunk_pos int, label string"), "id")


def test_mixed_band(spark):
    totals = votes(
        spark, (1, 0, "Quan"), (1, 1, "Quan"), (1, 2, "Qual"),
        (2, 0, "Quan"), (2, 1, "Quan"), (2, 2, "Quan"), (2, 3, "Qual"),
    )
    assert {r.id: r.yhat for r in scoring.decide(totals, "id", "Mix").collect()} == {1: "Mix", 2: "Quan"}
    shares = {(r.id, r.label): r.share for r in scoring.normalise_scores(totals, "id").collect()}
    assert shares[(2, "Qual")] == 0.25


def test_votes_tie_to_the_first_seen(spark):
    totals = votes(spark, (1, 0, "Z"), (1, 1, "A"), (1, 2, "A"), (1, 3, "Z"))
    assert scoring.decide(totals, "id").first().yhat == "Z"


def test_skipped_documents(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    scores = spark.createDataFrame(
        [(1, 0, 0, "A", 0.5), (2, 0, 0, "A", None)], "id int, chunk_pos int, label_pos int, label string, score double"
    )
    decided = scoring.decide(scoring.accumulate_scores(scores, "id"), "id", "Mix")
    assert [r.id for r in scoring.skipped(docs, decided, "id").collect()] == [2]

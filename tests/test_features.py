import random

import pytest

from corpuslab.operators import embeddings, features
from corpuslab.plans import scale


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "cc cc dd")], "id int, t string")


def test_tfidf_fixture(spark, docs):
    terms = features.bag_of_words(docs, "id", "t")
    rows = features.tfidf(terms, features.document_frequency(terms), 3, "id").collect()
    got = {(r.id, r.term): round(r.value, 6) for r in rows}
    assert got == {
        (1, "aa"): 0.934702, (1, "bb"): 0.355432, (2, "bb"): 0.707107, (2, "cc"): 0.707107,
        (3, "cc"): 0.835592, (3, "dd"): 0.549351,
    }


def test_vocabulary_is_alphabetical(spark, docs):
    rows = features.vocabulary(features.bag_of_words(docs, "id", "t")).collect()
    assert {r.term: r.idx for r in rows} == {"aa": 0, "bb": 1, "cc": 2, "dd": 3}


def test_unknown_terms_are_dropped(spark, docs):
    test = spark.createDataFrame([(9, "bb zz")], "id int, t string")
    for kind in ("bow", "tfidf"):
        rows = features.fit_features(docs, test, "id", "t", kind)[1].collect()
        assert [(r.term, r.value) for r in rows] == [("bb", 1.0)]
    with pytest.raises(ValueError):
        features.fit_features(docs, test, "id", "t", "onehot")


def test_profile_weights_and_ties(spark):
    df = spark.createDataFrame([(1, "a b a c b a"), (2, "")], "id int, t string")
    rows = features.ngram_profile(df, "id", "t", {1: 2}).collect()
    assert {r.ngram: round(r.weight, 6) for r in rows if r.ngram} == {"a": 0.6, "b": 0.4}
    assert [r.id for r in rows if r.ngram is None] == [2]
    tie = spark.createDataFrame([(1, "z y x")], "id int, t string")
    assert {r.ngram for r in features.ngram_profile(tie, "id", "t", {1: 2}).collect()} == {"z", "y"}


def test_class_profile_ties_go_to_the_earliest_document(spark):
    df = spark.createDataFrame([(2, "L", "q r"), (1, "L", "s"), (3, "L", "r")], "id int, label string, t string")
    rows = features.class_profile(df, "label", "id", "t", {1: 2}).collect()
    assert {r.ngram: r.cnt for r in rows} == {"r": 2, "s": 1}


def _plain_profile(rows, limits):
    """(label, n, ngram) -> count of the kept n-grams, by counting everything."""
    counts, first = {}, {}
    for key, label, t in rows:
        w = t.split()
        for n in limits:
            for at in range(len(w) - n + 1):
                g = (label, n, " ".join(w[at: at + n]))
                counts[g] = counts.get(g, 0) + 1
                first[g] = min(first.get(g, (key, at)), (key, at))
    kept = {}
    for label, n in {g[:2] for g in counts}:
        order = sorted((g for g in counts if g[:2] == (label, n)), key=lambda g: (-counts[g], first[g]))
        kept |= {g: counts[g] for g in order[: limits[n]]}
    return kept


@pytest.mark.parametrize("buckets", [1, 7, 1 << 15])
def test_class_profile_is_exact_for_any_number_of_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(features, "BUCKETS", buckets)
    rng = random.Random(buckets)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rng.choice("AB"), " ".join(rng.choices(words, range(1, 41), k=rng.randint(0, 30)))) for i in range(60)]
    limits = {1: 5, 2: 3, 3: 4}
    df = spark.createDataFrame(rows, "id int, label string, t string")
    got = features.class_profile(df, "label", "id", "t", limits).collect()
    assert {(r.label, r.n, r.ngram): r.cnt for r in got} == _plain_profile(rows, limits)


def test_class_profile_shuffles_no_rare_ngrams(spark):
    """Rows of n-grams that cannot be in a profile stay in their task: what is exchanged is bounded by the buckets."""
    rows = [(i, "A", f"top top top top u{i} v{i} x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string, t string")
    seen, real = [], features.cut_lineage
    features.cut_lineage = lambda d: seen.append(real(d)) or seen[-1]
    try:
        got = features.class_profile(df, "label", "id", "t", {1: 1}).collect()
    finally:
        features.cut_lineage = real
    assert [(r.ngram, r.cnt) for r in got] == [("top", 1200)]
    assert max(d.count() for d in seen if "ngram" in d.columns) < 20


def test_tasks_hold_a_bounded_share_of_the_texts(spark):
    """More text makes more partitions, also past spark.sql.shuffle.partitions, and the rows of a key stay together."""
    df = spark.range(64).selectExpr("id % 32 AS id", "repeat('ab cd ', 100) AS t")
    placed = scale.place_by_size(df, "id", "t", per_task=1200)
    assert placed.rdd.getNumPartitions() == 32 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = placed.selectExpr("id", "spark_partition_id() AS p").distinct()
    assert where.count() == 32 and placed.count() == 64
    many = spark.range(40).selectExpr("id", "repeat('ab cd ', 200000) AS t")
    assert features.bag_of_words(many, "id", "t").rdd.getNumPartitions() >= 40 * 1_200_000 // scale.TEXT_PER_TASK


@pytest.mark.parametrize("kind", ["bow", "tfidf"])
def test_terms_meet_the_vocabulary_in_as_many_partitions_as_the_texts_need(spark, monkeypatch, kind):
    """Before, every join of terms had spark.sql.shuffle.partitions tasks, whatever the size of the texts."""
    monkeypatch.setattr(features, "place_by_size", lambda df, key, text: scale.place_by_size(df, key, text, 300))
    train = spark.range(90).selectExpr("id", "concat_ws(' ', 'all', concat('t', id % 7), concat('own', id), 'x y zz zz') AS t")
    test = spark.range(90, 120).selectExpr("id", "concat_ws(' ', 'all', concat('t', id % 9)) AS t")
    got = features.fit_features(train, test, "id", "t", kind)
    assert all(side.rdd.getNumPartitions() >= 5 for side in got[kind == "bow":])
    counts = {r.term for r in got[1].filter("id % 9 >= 7").collect()}
    assert counts == {"all"}


def test_mean_word_vectors(spark):
    df = spark.createDataFrame([(1, "a a b zz"), (2, "zz"), (3, "")], "id int, t string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<double>")
    got = {r.id: [round(x, 6) for x in r.vec] for r in embeddings.mean_word_vectors(df, "id", "t", vectors, 2).collect()}
    assert got == {1: [0.666667, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_feature_means_and_zero_vector(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id int")
    feats = spark.createDataFrame(
        [(1, "t", [2.0]), (1, "t", [4.0]), (1, "j", [0.0])], "id int, feature string, vec array<double>"
    )
    got = {r.id: r.vec for r in embeddings.mean_features(nodes, feats, "id", 1).collect()}
    assert got == {1: [1.5], 2: [0.0]}


def test_categories(spark):
    nodes = spark.createDataFrame(
        [(1, "IEEE", None, ["Bio", "bio"]), (2, None, "Article", None), (3, "", "ieee", [])],
        "id int, publisher string, type string, subject array<string>",
    )
    index = embeddings.category_index(embeddings.category_values(nodes, ["publisher", "type"], ["subject"]))
    assert {r.value: r.idx for r in index.collect()} == {"article": 0, "bio": 1, "ieee": 2}
    rows = embeddings.multi_hot(nodes, "id", ["publisher", "type"], ["subject"], index).collect()
    assert {r.id: r.cat for r in rows} == {1: [1, 2], 2: [0], 3: [2]}


def test_many_categories(spark):
    nodes = spark.range(10_050).selectExpr("id", "concat('v', id) AS publisher", "array('x') AS subject")
    index = embeddings.category_index(embeddings.category_values(nodes, ["publisher"], ["subject"]))
    rows = embeddings.multi_hot(nodes, "id", ["publisher"], ["subject"], index)
    assert rows.filter("size(cat) = 2").count() == 10_050 and rows.selectExpr("max(cat[1])").first()[0] == 10_050


def test_feature_groups(spark):
    df = spark.createDataFrame([([1.0], [1], [0.5])], "struc array<double>, cat array<bigint>, emb array<double>")
    got = {g: tuple(df.select(embeddings.node_vector(g, 1, 2, 1).alias("v")).first().v) for g in embeddings.FEATURE_GROUPS}
    assert got["struc"] == (1, [0], [1.0]) and got["cat+emb"] == (3, [1, 2], [1.0, 0.5])
    assert got["all"] == (4, [0, 2, 3], [1.0, 1.0, 0.5])
    with pytest.raises(ValueError):
        embeddings.node_vector("emb+cat", 1, 1, 1)

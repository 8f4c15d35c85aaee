import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import bayes, experiments, features, foldbayes, splits

NAMES, ALPHAS = ["A", "B", "C"], [0.1, 1.0, 10.0]


def _views(spark):
    rng = random.Random(11)
    rows = []
    for i in range(90):
        label = NAMES[i % 3] if i % 17 else None
        words = [f"{label}{rng.randint(0, 9)}" if rng.random() < 0.4 else f"w{rng.randint(0, 25)}" for _ in range(rng.randint(0, 12))]
        rows.append((i, label, "full", " ".join([*words, f"only{i}"]) if i % 9 else None))
        rows.append((i, label, "short", " ".join(words[:2])))
    return spark.createDataFrame([r for r in rows if r[0] != 8 or r[2] == "full"], "id int, label string, data_type string, text string")


@pytest.mark.parametrize("least", [1 << 14, 40])
def test_blocks_answer_as_the_long_form(spark, monkeypatch, least):
    monkeypatch.setattr(foldbayes, "LEAST_TERMS", least)  # one block, then four
    views, by = _views(spark), ["data_type", "split"]
    docs = views.filter("data_type = 'full'").select("id", "label")
    roles = splits.stratified_splits(docs, "id", "label", 2).localCheckpoint()
    folded = experiments.folds_by_split(roles.filter("role = 'train'").drop("role"), "id", 3).localCheckpoint()
    tests = roles.filter("role = 'test'").drop("role")
    counts = features.bag_of_words(views, "id", "text", ["data_type"]).localCheckpoint()
    owned = folded.unionByName(tests.withColumn("fold", F.lit(-1)))
    rows = foldbayes.document_rows(counts, owned, "id", ["full", "short"], 2)
    got = foldbayes.split_answers(rows, NAMES, ALPHAS, ["bow", "tfidf"], 2, 3)
    got = got.groupBy("feature_type", *by, "fold", "point", "y", "yhat").count().collect()
    want = {}
    both = [d.withColumn("data_type", F.explode(F.array(F.lit("full"), F.lit("short")))) for d in (folded, tests)]
    raw = [counts.join(d, ["id", "data_type"]) for d in both]
    for kind in ("bow", "tfidf"):
        train, test = raw if kind == "bow" else experiments.tfidf_by(*raw, both[0], "id", by)
        cv = bayes.bayes_predictions(train, both[0], train, both[0], "id", NAMES, ALPHAS, by=by, fold="fold", folds=3)
        tested = bayes.bayes_predictions(train, both[0], test, both[1], "id", NAMES, ALPHAS, by=by).withColumn("fold", F.lit(-1))
        for r in cv.unionByName(tested, allowMissingColumns=True).groupBy(*by, "fold", "point", "y", "yhat").count().collect():
            want[kind, *r[:-1]] = r[-1]
    assert {tuple(r)[:-1]: r[-1] for r in got} == want
    assert sum(want.values()) == 2 * 2 * 2 * 3 * 90


def test_no_table_has_a_row_per_document_term_and_split(spark, monkeypatch):
    docs = spark.range(60).select(
        F.col("id"), F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int")).alias("label"), F.lit("full").alias("data_type"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"))
    most = []

    def noted(cut):
        def run(df):
            out = cut(df)
            most.append((out[0] if isinstance(out, tuple) else out).count())
            return out
        return run

    monkeypatch.setattr(experiments, "cut_lineage", noted(experiments.cut_lineage))
    monkeypatch.setattr(foldbayes, "cut_plan", noted(foldbayes.cut_plan))
    runs = experiments.bayes_split_metrics(docs, "id", ["A", "B"], ["full"], ["tfidf", "bow"]).collect()
    assert len(runs) == 10
    assert max(most) < 60 * 50  # 12,000 rows of training terms before: documents x terms x splits


def test_texts_without_any_term(spark):
    docs = spark.createDataFrame([(i, "AB"[i % 2], "full", "" if i % 3 else None) for i in range(30)], "id int, label string, data_type string, text string")
    runs = experiments.bayes_split_metrics(docs, "id", ["A", "B"], ["full"], ["tfidf", "bow"]).collect()
    assert len(runs) == 10 and all(r.accuracy == 0.5 for r in runs)

"""Language filters: Bloom answers, held-out accuracy, defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslab.llm import language

DIR = "/root/testdata/sf0.01"


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    found = {f"l{i:03d}": rng.integers(0, 1 << 40, 300) for i in range(70)}  # two mask planes
    model = language.GramFilter.build(found, "l000")
    assert model.planes.shape[0] == 2
    for i, name in enumerate(model.names):
        slots = language._slots(found[name].astype(np.uint64), model.planes.shape[1])
        masks = model.planes[i // 64][slots[0]] & model.planes[i // 64][slots[1]]
        assert ((masks >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert model.mistakes.max() < 0.05


def test_counts_are_those_of_the_text(spark):
    texts = {"en": "the cat and the dog", "de": "der hund und die katze"}
    model = language.GramFilter.build({k: np.unique(language.grams(v)).astype(np.int64) for k, v in texts.items()}, "en")
    for i, name in enumerate(model.names):
        hits, n = model.counts(texts[name])
        assert hits[i] == n == len(language.grams(texts[name]))
        assert model.predict(texts[name])[0] == name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.train(docs.filter(~language.held_out("doc_id")))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("out", language.held_out("doc_id")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_defined_cases(spark):
    learned = spark.createDataFrame(
        [(i, t, n) for i, (t, n) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)] * 3)],
        "doc_id long, text string, lang string")
    model = language.train(learned)
    assert model.names == ["de", "en"] and model.fallback in ("de", "en", "fr")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "THE DOG"), (4, "THE DOG"), (None, "der hund"), (5, "щ")], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (5, model.fallback)}
    empty = language.train(learned.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert docs.select(language.held_out(F.lit(None).cast("long"))).count() == 7

"""Quality rules against brute force, and the binomial bound against its definition."""

import math
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from corpuslab.llm import quality  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\n ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "one two three\none two three\n\n  \none two three",
    "l1\nl2\nl1\nl1 ", "##|<> a*b", "é ü x ß y", "a b a b a b a", " lead and trail ", "a\x0bb\x0cc\rd",
    " ".join(f"w{i % 40}" for i in range(400)), " ".join(f"w{(i * i) % 97}" for i in range(300)),
    " ".join(["the same four words"] * 50) + " " + " ".join(f"q{i}" for i in range(100)),
]


def test_statistics(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = quality.add_statistics(rows).select(
        "doc_id", "_s.n_words", "_s.word_chars", "_s.n_symbols", "_s.n_dup_lines", "_s.n_repeat_words").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_very_long_text_and_clashing_columns(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, _words string, _s string")
    out = quality.add_statistics(rows)
    assert out.columns == ["doc_id", "text", "_words", "_s"]
    assert out.select("_s.n_repeat_words").first()[0] == 60_000


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.add_statistics(rows)
    assert quality.judge(scored, quality.fit_cutoffs(scored, labels)).count() == 0


@pytest.mark.parametrize(("n", "alpha", "level"), [(10, 0.01, 0.05), (600, 0.01, 0.0025), (5000, 0.01, 0.01), (90_000, 0.02, 0.001)])
def test_binomial_bound(spark, n, alpha, level):
    total, k = 0.0, -1
    for x in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(alpha) + (n - x) * math.log1p(-alpha))
        if total > level:
            break
        k = x
    got = spark.range(1).select(quality.allowed_rejections(F.lit(n).cast("long"), alpha, F.lit(level))).first()[0]
    assert got == k


def test_cutoffs_keep_the_bound_per_stratum(spark):
    """Of the good documents of a stratum at most the allowed number is rejected; junk goes; a
    stratum without enough labels rejects nothing."""
    rows, labels = [], []
    for i in range(3000):
        lang, junk = ("en", None, "xx")[0 if i < 1500 else 1 if i < 2990 else 2], i % 10 == 0
        mark = "#### " if junk else ("# " if i % 97 == 0 else "")
        rows.append((i, " ".join(f"{mark}word{i}x{k}" for k in range(60)), lang))
        labels.append((i, 0 if junk else 1))
    labels += [(None, 1), (5, None), (10**9, 1), (1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scored = quality.add_statistics(docs).cache()
    cutoffs = quality.fit_cutoffs(scored, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.stratum for r in cutoffs.collect()} == {"en", ""}
    out = {r.doc_id: r.kept for r in quality.judge(scored, cutoffs).collect()}
    assert len(out) == 3000
    for low, high in ((0, 1500), (1500, 2990)):
        good = [i for i in range(low, high) if i % 10]
        assert sum(not out[i] for i in good) <= 0.01 * len(good)
        assert not any(out[i] for i in range(low, high, 10))
    assert all(out[i] for i in range(2990, 3000))


def test_base_rules_and_ties(spark):
    fifty, less = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    half = " ".join(["a b c", "a b c"] + [f"w{i}" for i in range(54)])
    docs = spark.createDataFrame([(1, fifty, "en"), (1, fifty, "en"), (2, less, None), (3, None, "en"), (4, half, "en")], "doc_id long, text string, lang string")
    scored = quality.add_statistics(docs)
    none = spark.createDataFrame([], "stratum string, cutoffs array<int>")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality.judge(scored, none).collect())
    assert got == [(1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, False, True)]


def test_small_strata_are_pooled(spark):
    """Strata that prove nothing alone lose their junk together, within the bound over the pool; without
    enough good documents in all of them they still lose nothing."""
    rows, labels = [], []
    for i in range(1100):
        junk = i % 10 == 0
        mark = "#### " if junk else ""
        rows.append((i, " ".join(f"{mark}word{i}x{k}" for k in range(60)), f"l{i % 3}"))
        labels.append((i, 0 if junk else 1))
    scored = quality.add_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string")).cache()
    held = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.fit_cutoffs(scored, held).count() == 0
    out = {r.doc_id: r.kept for r in quality.judge(scored, quality.fit_cutoffs(scored, held, pool=True)).collect()}
    assert [i for i in out if not out[i]] and all(out[i] == bool(i % 10) for i in out)
    assert quality.fit_cutoffs(scored, held.limit(300), pool=True).count() == 0


def test_pipeline_drops_labelled_junk_of_every_language(spark):
    """sf0.1: of the labelled bad documents past the base rules those full of symbols go, in all languages."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.add_statistics(docs.join(labels.select("doc_id", "quality"), "doc_id")).filter(~quality.base_failed()).select(
        "doc_id", "lang", "quality", (F.col("_s.n_symbols") / F.col("_s.word_chars")).alias("symbols")).cache()
    kept = corpus_pipeline.quality_rules(spark, docs, folder).select("doc_id").withColumn("kept", F.lit(1))
    found = {(r.lang, r.quality): r for r in scored.join(kept, "doc_id", "left").groupBy("lang", "quality").agg(
        F.count("*").alias("n"), F.count("kept").alias("kept"), F.expr("count_if(symbols >= 0.1 and kept = 1)").alias("junk")).collect()}
    for lang in ("de", "en", "es", "fr"):
        assert found[lang, 0].junk == 0 and found[lang, 0].kept < 0.1 * found[lang, 0].n
    small = [found[lang, 1] for lang in ("de", "es", "fr")]
    assert sum(r.n - r.kept for r in small) <= quality.ALPHA * len(quality.RULES) * sum(r.n for r in small)

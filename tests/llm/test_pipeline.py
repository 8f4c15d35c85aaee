"""The pipeline's stages against brute force on their own inputs."""

import math
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from corpuslab.llm import bpe, quality  # noqa: E402
from corpuslab.llm.queries import vocabulary  # noqa: E402
from test_mixing import brute_mix  # noqa: E402
from test_quality import brute as brute_statistics  # noqa: E402
from test_simhash import brute_components, brute_print  # noqa: E402
from test_suffix import brute as brute_removal  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [frame.collect() for frame in out]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "suffix-array dedup", "source mixing", "byte-level BPE"]
    for rows in stages[:5]:
        assert set(rows[0].asDict()) == set(corpus_pipeline.DOCUMENTS)


def test_quality(stages):
    """Too few labels here for any cutoff, so the base rules alone decide."""
    kept = set()
    for r in stages[0]:
        words, _, _, _, repeated = brute_statistics(r.text)
        if words >= quality.MIN_WORDS and 100 * repeated <= 50 * words:
            kept.add(r.doc_id)
    assert {r.doc_id for r in stages[1]} == kept


def test_near_duplicates(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    roots = brute_components([brute_print(r.text) for r in rows])
    assert {r.doc_id for r in stages[2]} == {r.doc_id for i, r in enumerate(rows) if roots[i] == i}


def test_repeats(stages):
    expected = brute_removal([(r.doc_id, r.text) for r in stages[2]])
    assert len(stages[3]) == len(stages[2])
    before = {r.doc_id: r.text for r in stages[2]}
    for r in stages[3]:
        assert r.n_chars == len(r.text)
        n, gone, spans, _ = expected[r.doc_id]
        if not spans:
            assert r.text == before[r.doc_id]
        assert n - gone - 6 * spans <= len(r.text.encode()) <= n - gone


def test_mix(stages):
    rows = []
    for r in stages[3]:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        rows.append((r.doc_id, r.source, size, 0.25 + 0.75 * min(size, 200) / 200.0))
    copies = {r[0]: r[3] for r in brute_mix(rows)}
    got = {}
    for r in stages[4]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
    assert math.isclose(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[4]), 1.5 * sum(r[2] for r in rows), rel_tol=0.1)


def test_tokens(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary()), special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))


def test_defined_cases_go_through_every_stage(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "w " * 10_000, "en", "a", 1), (2, "w " * 10_000, "en", "a", 1),
            (3, " ".join(f"x{i}" for i in range(100)), None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() <= 2 * len(rows)
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, ids with two texts and null ids: what stays is decided by row, not by id."""
    text = [" ".join(f"{chr(97 + i)}{k}" for k in range(60)) for i in range(5)]
    rows = [
        (1, text[0], "en"), (1, text[0], "en"), (1, text[0], "de"),  # one of three stays
        (2, text[0], "en"), (2, text[1], "en"),  # a copy of 1 goes, the other text of 2 stays
        (3, text[2], "en"), (None, text[2], "en"),  # the row without an id goes
        (None, text[3], "en"), (None, text[3], "en"), (None, text[3], "fr"), (None, text[4], "en"),  # one of each text
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_dedup(spark, docs, DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(1, text[0]), (2, text[1]), (3, text[2]), (None, text[3]), (None, text[4])], key=str)

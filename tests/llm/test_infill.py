import hashlib

import numpy as np
import pyarrow as pa
import pytest

from corpuslab.llm import infill, queries


def brute(doc_id, text):
    """The contract, with Python strings."""
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}", text
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}", text


TEXTS = [
    None, "", "a", "ab", "<", "<P", "P>", "><", "<P>", "x<S>y", "<M", "<M>", "S><S", "é", "日本語テキスト", "😀😀<😀>", "áb\u0000c",
    "line\nline\r\n\ttab", " ", "<<<<<<>>>>>>", "end<", "<PSM>", "zwj ‍ x", "word " * 400, "ß日😀<" * 3000,
]


def rows_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def check(spark, rows, df):
    got = infill.restore(infill.transform(df)).collect()
    want = sorted((brute(i, t) for i, t in rows), key=repr)
    assert sorted((tuple(r)[1:] for r in got), key=repr) == want


@pytest.mark.parametrize("window,slice_", [(1 << 18, 4 << 20), (5, 64)])
def test_against_brute_force(spark, monkeypatch, window, slice_):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(12 * len(TEXTS))] + [(None, "no id"), (None, None), (3, "twice"), (3, "twice")]
    batch = pa.table({"t": [t or "" for _, t in rows]})["t"].combine_chunks()
    monkeypatch.setattr(infill, "WINDOW", window)
    want = [brute(i, t) for i, t in rows]
    numbers = [np.array([w[j] or 0 for w in want]) for j in (0, 2)]
    second = np.array([(w[2] or 0) + (w[3] or 0) for w in want])
    form = np.array([["plain", "psm", "spm"].index(w[1]) for w in want])
    assert set(form) == {0, 1, 2}
    out = infill.rearrange(batch, numbers[0], form, numbers[1], second)
    assert out.to_pylist() == [w[4] for w in want]
    assert infill.put_back(out, form).to_pylist() == [w[5] for w in want]
    monkeypatch.setattr(infill, "SLICE", slice_)
    parts = list(infill.byte_slices([pa.record_batch({"t": batch})], 0))
    assert pa.concat_arrays([p.column(0) for p in parts]).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or p.column(0).nbytes <= slice_ + 8 * p.num_rows for p in parts)
    check(spark, rows, rows_of(spark, rows))


def test_very_long_text(spark):
    text = "日本 <text> é " * 400_000
    rows = [(i, text) for i in range(3)] + [(7, "")]
    check(spark, rows, rows_of(spark, rows))


def test_clashing_columns_and_empty_table(spark):
    df = rows_of(spark, [(1, "some text", 5, "x", "y", 1)], ", n int, form string, output string, key int")
    check(spark, [(1, "some text")], df)
    empty = infill.restore(infill.transform(rows_of(spark, [])))
    assert empty.collect() == [] and empty.columns[-1] == "restored"


def test_restores_from_output_and_form_alone(spark):
    made = infill.transform(rows_of(spark, [(i, f"text number {i} é") for i in range(200)]))
    back = infill.restore(made.select("form", "output", "doc_id")).collect()
    assert all(r.restored == f"text number {r.doc_id} é" for r in back)


def test_query_digests(spark):
    directory = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    got = queries.op11_fill_in_middle(spark, directory).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, prefix, middle, output, text = brute(r.doc_id, docs[r.doc_id])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text)]
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, *sha)

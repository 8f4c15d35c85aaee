"""Maximal repeats and the removal of repeated strings against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from corpuslab.llm import suffix


def brute_maximal(texts, length):
    found = defaultdict(list)
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + length, len(x) + 1):
                found[x[i:j]].append((t, i))
    out = {}
    for w, places in found.items():
        left = {texts[t][i - 1] if i else -1 - t for t, i in places}
        right = {texts[t][i + len(w)] if i + len(w) < len(texts[t]) else -1 - t for t, i in places}
        if len(places) > 1 and len(left) > 1 and len(right) > 1:
            out[w] = sorted(places)
    return out


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out[doc] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(docs, length=100):
    out = suffix.remove_repeats(docs, suffix.repeats(docs, length=length)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}


@pytest.mark.parametrize("seed", range(40))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 16))) for _ in range(rng.randint(1, 6))]
    length = rng.randint(2, 4)
    got = {texts[p[0][0]][p[0][1]:p[0][1] + n]: sorted(p) for n, p in suffix.maximal_repeats(texts, length)}
    assert got == brute_maximal(texts, length)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_spans_cover_what_brute_force_covers(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(6)]
    places, covered, seen = [(t, 0) for t in range(6)], set(), set()
    for t, x in enumerate(texts):
        for s in range(len(x) - 2):
            if x[s:s + 3] in seen:
                covered |= {(t, s + k) for k in range(3)}
            seen.add(x[s:s + 3])
    assert {(d, p) for d, s, e in suffix.repeated_spans(texts, places, 3) for p in range(s, e)} == covered


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(14)
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 300), (4, "x" * 99), (5, "x" * 100), (6, "x" * 101), (7, "to " * 90)]
    for i in range(10, 60):
        text = prose(rng.randint(1, 120))
        if i % 3 == 0:
            text = text[: len(text) // 2] + shared[rng.randint(0, 90): rng.randint(150, 400)] + text[len(text) // 2:]
        if i % 4 == 0:
            text += "\n" + line + "\n" + prose(20) + "\n" + line
        rows.append((i, text))
    rows += [(100, rows[20][1]), (101, rows[20][1][:-5] + "zzz"), (102, rows[25][1] + rows[26][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal(spark, seed, monkeypatch):
    rows = documents(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(docs) == brute(rows)


def test_hot_anchors_give_the_same_rows(spark, monkeypatch):
    rows = documents(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix, "HOT_ROWS", 4)
    assert suffix.hot_anchors(docs.selectExpr("doc_id doc", "text content").filter("content is not null"), share=0.0)
    monkeypatch.setattr(suffix, "HOT_SHARE", 0.0)
    assert removed(docs) == brute(rows)


def test_repeated_rows_null_ids_extra_columns_and_empty_table(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text, "a"), (3, text, "a"), (None, text, "b"), (9, text, "c")], "doc_id long, text string, anchor string")
    got = sorted((r.doc_id or -1, r.anchor, r.n_removed, r.kept) for r in suffix.remove_repeats(docs, suffix.repeats(docs), carry=["anchor"]).collect())
    assert got == [(-1, "b", 0, text), (3, "a", 0, text), (3, "a", 0, text), (9, "c", len(text), "")]
    assert removed(docs.limit(0)) == {}

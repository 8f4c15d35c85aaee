"""Budgets and draws of the mix against brute force."""

import hashlib
import math

import pytest

from corpuslab.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, list(names)
    while free:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in free)
        over = [s for s in free if most * sizes[s] <= level * w[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.remove(s)
    return target


def brute_mix(rows):
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets, out = brute_targets(sizes), []
    for s in sizes:
        mine, before = [], 0
        for key, source, n, w in rows:
            if source == s:
                x = int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:13], 16)
                mine.append((-math.log((x + 0.5) / 2**52) / w, key, n))
        epochs = math.floor(targets[s] / sizes[s]) if sizes[s] else 1
        rest = targets[s] - epochs * sizes[s]
        for _, key, n in sorted(mine):
            copies = epochs + (rest > 0 and before + n / 2 <= rest)
            out.append((key, s, n, copies, copies * n, sizes[s], targets[s]))
            before += n
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    return [(r.doc_id, r.source, r["size"], r.copies, r.taken, r.source_size, r.target) for r in mixing.mix(docs).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = [(i, f"s{(i * seed) % 7 if i % 3 else 0}", (i * 37 * seed) % 400, 0.25 + (i % 4) / 4) for i in range(500)]
    rows += [(i, None, 10 + i % 5, 1.0) for i in range(500, 530)] + [(600, "huge", 50_000, 1.0), (601, "é", 5, 1.0), (602, "zero", 0, 1.0)]
    got, expected = run(spark, rows), brute_mix(rows)
    key = lambda r: (r[0], r[1] or "")
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], rel=1e-12)
    for source in {r[1] for r in rows}:
        mine = [r for r in got if r[1] == source]
        assert abs(sum(r[4] for r in mine) - mine[0][6]) <= max(r[2] for r in mine) / 2 + 1e-6
        assert all(r[4] <= 2 * r[2] for r in mine)
    assert sorted(got, key=key) == sorted(run(spark, rows), key=key)


def test_heavier_documents_are_drawn_first(spark):
    rows = [(i, s, 10, 1.0 if i % 2 or s != "b" else 0.1) for s in "abc" for i in range(2000)]
    got = [r for r in run(spark, rows) if r[1] == "b"]
    drawn = [r for r in got if r[3]]
    assert 0 < len(drawn) < len(got)
    assert sum(r[0] % 2 for r in drawn) > 0.55 * len(drawn)


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a", 5, None), (1, "a", 5, -1.0), (1, "a", 5, -1.0), (2, None, 0, 1.0)]
    got = run(spark, rows)
    assert len(got) == 4 and sum(r[4] for r in got if r[1] == "a") in (20, 25, 30)
    assert run(spark, []) == []

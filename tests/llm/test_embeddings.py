"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from corpuslab.llm import embeddings


def brute(rows, cosine=0.95):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ok):
        a = np.array(rows[i][1], dtype=np.float64)
        for j in ok[:n]:
            b = np.array(rows[j][1], dtype=np.float64)
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[y] = x
    least = {}
    for i in ok:
        r = find(i)
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((k is not None, k or 0, links[i], least.get(find(i), k) or 0) for i, (k, _) in enumerate(rows)))


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = embeddings.near_duplicates(frame).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id or 0) for r in out)


def vectors(seed, groups=12, dim=16):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(groups):
        center = rng.standard_normal(dim)
        for k in range(int(rng.integers(1, 9))):
            v = center + 0.05 * k * rng.standard_normal(dim)
            rows.append([float(np.float32(x)) for x in v * rng.uniform(0.1, 50)])
    rows += [rows[0]] * 4 + [[x * 2 for x in rows[0]]]
    order = rng.permutation(len(rows))
    return [(int(k) * 3, rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links(spark, seed):
    rows = vectors(seed)
    assert run(spark, rows) == brute(rows)


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    rows = vectors(4, groups=8)
    assert run(spark, rows) == brute(rows)


def test_unusable_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.0]),
            (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.0]), (6, [1.0, 0.01]), (10, [1e-30, 0.0]), (11, [3e38, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_recall_at_the_threshold():
    width, tables = embeddings.plan(1_000_000, 0.95)
    near = embeddings.collision((2 - 2 * 0.95) ** 0.5) ** width
    assert (1 - near) ** tables <= 1e-3


def test_doubles_and_integers(spark):
    rows = [(1, [1.0, 1e-9]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    for kind in ("double", "int"):
        frame = spark.createDataFrame([(k, [int(x) for x in v] if kind == "int" else v) for k, v in rows], f"vec_id long, embedding array<{kind}>")
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect())
        assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]

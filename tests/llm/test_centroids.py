import hashlib

import numpy as np
import pytest

from corpuslab.llm import centroids, queries
from corpuslab.llm.centroids import LIMIT, Search


def brute(rows, k=8, rounds=10, size=64, scale=1024):
    """The contract with Python integers."""
    kept = []
    for key, vec in rows:
        if vec is None or len(vec) != size or any(x is None or not np.isfinite(x) for x in vec):
            continue
        kept.append((key, tuple(int(np.floor(scale * float(x))) for x in vec)))
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(col) // len(vs) for col in zip(*vs)]
    last = [(i, *nearest(v)) for i, v in kept]
    own = {}
    for _, d, n in last:
        own[n] = own.get(n, 0) + d
    return [
        (i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
        for i, d, n in last
    ]


def check(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = centroids.digests(centroids.cluster(df, **options)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, **options)))


def vectors(n, seed, centre=0.0, size=64):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in np.float32(v)] for v in rng.normal(centre, 0.2, (n, size))]


def test_against_brute_force(spark):
    odd = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [float("inf")] + [0.1] * 63, [-float("inf")] + [0.1] * 63]
    rows = list(enumerate(vectors(150, 1) + vectors(40, 2, 1.0) + [[0.0] * 64] * 3 + [[-0.5] * 64] + odd))
    rows += [(None, rows[0][1]), (5, rows[9][1]), rows[7], rows[7]]
    check(spark, rows)


def test_most_vectors_are_copies(spark):
    rows = [(i, [0.25] * 64) for i in range(60)] + list(enumerate(vectors(20, 3), 60))
    check(spark, rows)


def test_few_vectors_and_none(spark):
    check(spark, list(enumerate(vectors(3, 4))))
    check(spark, [(1, [0.5] * 64)])
    check(spark, [(1, None)])
    check(spark, [])


def test_other_parameters_and_doubles(spark):
    rows = list(enumerate(vectors(80, 5, size=5)))
    check(spark, rows, "double", k=13, rounds=4, size=5, scale=100)
    check(spark, [(i, [v[0] * 50]) for i, v in rows], "double", k=5, rounds=3, size=1, scale=7)


def test_clashing_columns(spark):
    rows = list(enumerate(vectors(20, 6)))
    df = spark.createDataFrame(
        [(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int, key string")
    got = centroids.digests(centroids.cluster(df)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_too_large_components(spark):
    with pytest.raises(ValueError):
        check(spark, [(1, [1e30] * 64)], "double")
    with pytest.raises(ValueError):
        check(spark, [(1, [-1e30] * 64)], "double")


@pytest.mark.parametrize("top", [3, 1000, LIMIT])
def test_search_is_exact_and_prunes(top):
    rng = np.random.default_rng(7)
    for size, k in ((64, 8), (64, 200), (1, 5), (3, 40)):
        c = rng.integers(-top, top + 1, (k, size))
        c[k // 2] = c[0]  # equal centroids: the smaller number answers
        x = np.concatenate([rng.integers(-top, top + 1, (300, size)), c, np.full((1, size), top), np.full((1, size), -top)])
        search = Search(c)
        number, distance = search.nearest(x)
        for i, v in enumerate(x):
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, row)) for row in c]
            assert (distance[i], number[i]) == min((e, j) for j, e in enumerate(d))
        if size == 1:
            assert search.compared < len(x) * k / 2


def test_bounds_reject_in_separated_data():
    rng = np.random.default_rng(8)
    c = rng.integers(-5, 5, (50, 64)) + 100 * np.arange(50)[:, None]
    search = Search(c)
    search.nearest(np.repeat(c, 20, axis=0) + rng.integers(-3, 4, (1000, 64)))
    assert search.compared < 3 * 1000


def test_query(spark):
    directory = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{directory}/embeddings.parquet").collect()]
    got = queries.op13_centroid_clustering(spark, directory).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))

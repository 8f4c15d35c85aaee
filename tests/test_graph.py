import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import graph
from corpuslab.plans.scale import hot_join, hot_keys

FIXTURE = [(1, 2), (2, 3), (1, 3), (3, 1)]


def make(spark, edges):
    e = spark.createDataFrame(edges, "src int, dst int").distinct()
    n = spark.createDataFrame([(x,) for x in sorted({v for p in edges for v in p})], "id int")
    return n, e


def column(df, name, digits=6):
    return {r.id: round(getattr(r, name), digits) for r in df.collect()}


def test_fixture(spark):
    nodes, edges = make(spark, FIXTURE)
    deg = graph.degrees(nodes, edges)
    assert column(deg, "in_degree") == {1: 0.333333, 2: 0.333333, 3: 0.666667}
    assert column(deg, "out_degree") == {1: 0.666667, 2: 0.333333, 3: 0.333333}
    assert column(graph.mean_path(nodes, edges), "mean_path") == {1: 0.666667, 2: 1.0, 3: 1.0}
    assert column(graph.clustering(nodes, edges), "clustering") == {1: 0.5, 2: 1.0, 3: 0.5}
    assert column(graph.pagerank(nodes, edges), "pagerank", 4) == {1: 0.3878, 2: 0.2148, 3: 0.3974}


def random_edges(seed, n=14, m=45, loops=True):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted((a, b) for a, b in pairs if loops or a != b)


def paths(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for s in {v for p in edges for v in p}:
        dist, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in near.get(u, ()):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
        out[s] = round(sum(dist.values()) / len(dist), 6)
    return out


def matrix_clustering(edges):
    ids = sorted({v for p in edges for v in p})
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, t in edges:
        if s != t:
            a[at[s], at[t]] = 1
    both = a + a.T
    tri = np.diag(np.linalg.matrix_power(both, 3)) / 2
    d = both.sum(1)
    r = (a * a.T).sum(1)
    return {v: round(float(tri[i] / (d[i] * (d[i] - 1) - 2 * r[i])), 6) if tri[i] else 0.0 for v, i in at.items()}


def power_rank(edges, rounds):
    ids = sorted({v for p in edges for v in p})
    out = {v: [b for a, b in edges if a == v] for v in ids}
    r = {v: 1 / len(ids) for v in ids}
    for _ in range(rounds):
        lost = sum(r[v] for v in ids if not out[v])
        new = {v: 0.15 / len(ids) + 0.85 * lost / len(ids) for v in ids}
        for v in ids:
            for w in out[v]:
                new[w] += 0.85 * r[v] / len(out[v])
        r = new
    return {v: round(x, 6) for v, x in r.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("split_hubs", [False, True])
def test_random_graphs_against_brute_force(spark, seed, split_hubs):
    edges = random_edges(seed)
    nodes, e = make(spark, edges)
    hot = {v: 3 for v in range(0, 14, 2)} if split_hubs else {}
    assert column(graph.mean_path(nodes, e, hot=hot or None), "mean_path") == paths(edges)
    reached, sums = graph.path_lengths(nodes, e, nodes), {}
    for r in reached.collect():
        total, n = sums.get(r.source, (0, 0))
        sums[r.source] = (total + r.dist, n + 1)
    assert {s: round(t / n, 6) for s, (t, n) in sums.items()} == paths(edges)
    assert column(graph.clustering(nodes, e, hot=hot), "clustering") == matrix_clustering(edges)
    ranks = column(graph.pagerank(nodes, e, rounds=4, hot=hot), "pagerank")
    assert ranks == power_rank(edges, 4)
    assert abs(sum(ranks.values()) - 1) < 1e-4


def test_paths_of_more_than_one_batch(spark):
    edges = random_edges(9, n=150, m=260)
    nodes, e = make(spark, edges)
    frame = graph.mean_path(nodes, e)
    assert column(frame, "mean_path") == paths(edges)


def test_rank_without_convergence_raises(spark):
    nodes, edges = make(spark, random_edges(3))
    with pytest.raises(ValueError):
        graph.pagerank(nodes, edges, tolerance=0.0, max_rounds=2)


def test_build_drops_unknown_ends_and_isolated_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x"), ("y", "b")], "src string, dst string")
    meta = spark.createDataFrame([("a", "P", ["s"]), ("b", "", []), ("c", "Q", ["t"])], "id string, publisher string, subject array<string>")
    nodes, kept = graph.build_graph(edges, meta, "id")
    assert sorted((r.src, r.dst) for r in kept.collect()) == [("a", "b")]
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"]
    rows = {r.id: (r.publisher, r.subject) for r in graph.node_attributes(nodes, meta, "id", ["publisher", "subject"]).collect()}
    assert rows == {"a": ("P", ["s"]), "b": (None, None)}


def test_corpus_filter_and_text(spark):
    edges = spark.createDataFrame([("a", "b"), ("z", "b")], "src string, dst string")
    corpus = spark.createDataFrame([("a",)], "doc string")
    assert [r.src for r in graph.corpus_edges(edges, corpus, "doc").collect()] == ["a"]
    meta = spark.createDataFrame([("a",), ("b",)], "id string")
    texts = spark.createDataFrame([("a", "Intro")], "id string, sec_name string")
    assert {r.id: r.sec_name for r in graph.attach_text(meta, texts, "id").collect()} == {"a": "Intro", "b": None}


def test_hub_is_found_and_split(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(90)] + [(0, 1)], "src int, dst int")
    assert hot_keys(edges, "dst") == {0: 16}  # four shuffle partitions of 23 rows
    assert hot_keys(edges, "src") == {}


def test_a_hub_is_spread_over_the_tasks(spark):
    """One key with 30 % of the rows in 64 partitions: no task gets more than twice the mean."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(64_000).selectExpr("id", "IF(id % 10 < 3, 0, id) AS k")
        right = left.select("k").distinct().withColumn("v", F.lit(1))
        hot = hot_keys(left, "k")
        sizes = hot_join(left, right.hint("merge"), "k", hot, ["id"]).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 64_000
        assert max(r["count"] for r in sizes) <= 2 * 64_000 / 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_roles_index_subgraph(spark):
    nodes, edges = make(spark, [(10, 20), (20, 30), (30, 10), (30, 40)])
    index = graph.index_nodes(nodes)
    assert {r.id: r.idx for r in index.collect()} == {10: 0, 20: 1, 30: 2, 40: 3}
    sub, sub_edges = graph.induced_subgraph(edges, nodes.filter("id <> 20"))
    assert {r.id: r.idx for r in sub.collect()} == {10: 0, 30: 1, 40: 2}
    assert sorted((r.src_idx, r.dst_idx) for r in sub_edges.collect()) == [(1, 0), (1, 2)]
    splits = spark.createDataFrame([(10, 0, "train"), (20, 0, "test")], "id int, split int, role string")
    labels = spark.createDataFrame([(10, 1), (20, 0)], "id int, y int")
    rows = {r.id: (r.y, r.role) for r in graph.node_roles(index, splits, labels, 1).collect()}
    assert rows == {10: (1, "train"), 20: (0, "val"), 30: (-1, "test"), 40: (-1, "test")}


def test_neighbour_aggregates(spark):
    nodes, edges = make(spark, [(1, 2), (1, 3), (2, 3)])
    values = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 40.0)], "id int, value double")
    rows = {r.id: (r.avg, r.min, r.max) for r in graph.neighbour_stats(edges, values).collect()}
    assert rows == {1: (30.0, 20.0, 40.0), 2: (40.0, 40.0, 40.0)}
    feats = spark.createDataFrame([(1, [0.0]), (2, [2.0]), (3, [4.0])], "id int, vec array<double>")
    for hot in ({}, {1: 2}):
        means = {r.id: r.vec for r in graph.neighbour_means(nodes, edges, feats, 1, hot=hot).collect()}
        assert means == {1: [0.0, 0.0], 2: [2.0, 1.0], 3: [4.0, 2.0]}

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.plans import scale


def test_global_rank_with_a_dominant_group(spark):
    rng = random.Random(0)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = {(r.g, r.i): r.rank for r in scale.global_rank(df, ["i"], within=["g"]).collect()}
    for group in {g for g, _ in rows}:
        for at, i in enumerate(sorted(i for g, i in rows if g == group)):
            assert got[(group, i)] == at
    flat = {r.i: r.rank for r in scale.global_rank(df.select("i"), ["i"]).collect()}
    assert flat == {i: i for i in range(3000)}


def test_running_blocks_equal_a_plain_scan(spark):
    rng = random.Random(1)
    values = {g: [rng.choice([None, rng.randint(0, 99)]) for _ in range(n)] for g, n in (("a", 50), ("b", 3))}
    df = spark.createDataFrame([(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)], "g string, i int, v int")
    for how, fold in (("min", min), ("max", max)):
        rows = scale.running(df, "g", "i", "v", how, "x", block=7).collect()
        for r in rows:
            seen = [v for v in values[r.g][: r.i] if v is not None]
            assert r.x == (fold(seen) if seen else None)
    with pytest.raises(ValueError):
        scale.running(df, "g", "i", "v", "sum", "x")


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_hot_join_equals_a_plain_join(spark, how):
    left = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(200)], "i int, k int")
    right = spark.createDataFrame([(k, k * 10 + j) for k in range(0, 30, 3) for j in range(2)], "k int, w int")
    want = sorted(map(tuple, left.join(right, "k", how).collect()))
    assert sorted(map(tuple, scale.hot_join(left, right, "k", {0: 4}, ["i"], how).collect())) == want


def test_bounded_tables(spark):
    df = spark.createDataFrame([("a", [0.1, 1e-17]), ("b", None)], "label string, vec array<double>").orderBy("label")
    row = spark.range(1).select(scale.inline_table(df).alias("t")).first()
    assert [(x.label, x.vec) for x in row.t] == [("a", [0.1, 1e-17]), ("b", None)]
    with pytest.raises(ValueError):
        scale.inline_table(df, limit=1)


def test_compute_once_is_not_merged(spark):
    df = scale.compute_once(spark.range(3), x=F.col("id") + 1)
    assert [(r.id, r.x) for r in df.orderBy("id").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_checkpoint_folder_of_the_cluster_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    scale.ensure_checkpoint_dir(spark)
    used = spark.sparkContext.getCheckpointDir()
    assert used and (not named or named.rstrip("/") in used)

import os
import time

import numpy as np
from pyspark.sql import functions as F

from corpuslab.operators import contrastive
from corpuslab.plans import scale


def shuffle_files(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for top in root for _, _, names in os.walk(top) for f in names)


def collected(spark):
    """What a collection finds goes a moment later, some of it with the next."""
    for _ in range(4):
        scale.drop_unused(spark, 0.0)
        time.sleep(1)


def test_shuffle_files_go_when_a_plan_is_cut(spark, monkeypatch):
    monkeypatch.setattr(scale, "_released", -1e9)
    collected(spark)
    before = shuffle_files(spark)
    held = scale.cut_lineage(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    assert shuffle_files(spark) > before
    collected(spark)
    assert shuffle_files(spark) <= before and held.count() == 1000


def test_pairs_hold_vectors_as_the_table_has_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 4)).astype(np.float32)
    table = spark.createDataFrame([(0, i, (7 * i + 1) % 30, i % 2) for i in range(30)], "model int, anchor int, partner int, similar int")
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, vec array<float>")
    real, kinds = contrastive.cut_plan, []

    def seen(df):
        kinds.append(df.schema["u"].dataType.simpleString())
        return real(df)

    monkeypatch.setattr(contrastive, "cut_plan", seen)
    single, losses = contrastive.learn_body(table, rows, "id", 4, epochs=2)
    double, same = contrastive.learn_body(table, rows.withColumn("vec", F.col("vec").cast("array<double>")), "id", 4, epochs=2)
    assert kinds == ["array<float>", "array<double>"]
    assert np.abs(single[0] - double[0]).max() < 1e-12 and np.allclose([x[2] for x in losses], [x[2] for x in same])

"""Search over training parameters by a surrogate: expected improvement of a Gaussian process over finished runs.

Candidates are rows of a table that Spark makes from hashes, so a million of them are scored in tasks; the
process is fitted on the driver from the finished runs, of which at most ``max_runs`` (the best and the latest
halves, the documented bound) are used. The greatest expected improvements that differ from all finished runs
are the next points.

A space maps a name to {'min', 'max'} (uniform, with 'int' for whole numbers) or {'values'}.
Runs without a finite score and points outside the space are left out; without any run the first candidates
are the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALES = (0.1, 0.2, 0.4, 0.8, 1.6)
NOISE = 1e-4


def candidates(spark: SparkSession, space: Mapping[str, dict], n: int, seed: int = 42) -> DataFrame:
    """(candidate, a column per parameter, unit array<double>): n points by hash, and their places in [0, 1]."""
    rows = spark.range(n).withColumnRenamed("id", "candidate")
    for i, (name, spec) in enumerate(space.items()):
        u = F.pmod(F.xxhash64("candidate", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.withColumn(name, _value(u, spec))
    return rows.withColumn("unit", F.array(*(_place(F.col(name), spec) for name, spec in space.items())))


def _value(u: Column, spec: dict) -> Column:
    if "values" in spec:
        return F.element_at(F.lit(list(spec["values"])), F.floor(u * len(spec["values"])).cast("int") + 1)
    whole = spec["min"] + u * (spec["max"] - spec["min"] + (1 if spec.get("int") else 0))
    return F.floor(whole).cast("long") if spec.get("int") else whole


def _place(value: Column, spec: dict) -> Column:
    """Values of a list stand at even places; null outside the space."""
    if "values" in spec:
        return (F.array_position(F.lit(list(spec["values"])), value) - 1).cast("double") / max(len(spec["values"]) - 1, 1)
    inside = (value >= spec["min"]) & (value <= spec["max"])
    return F.when(inside, (value - spec["min"]).cast("double") / max(spec["max"] - spec["min"], 1e-300))


class Process:
    """A Gaussian process with a radial kernel; its length is the likeliest of ``SCALES``."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.scale = x, y.mean(), y.std() or 1.0
        z = (y - self.mean) / self.scale
        far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
        best = None
        for length in SCALES:
            k = np.exp(-far / (2 * length**2)) + NOISE * np.eye(len(x))
            root = np.linalg.cholesky(k)
            a = np.linalg.solve(root.T, np.linalg.solve(root, z))
            likely = -0.5 * z @ a - np.log(np.diag(root)).sum()
            if best is None or likely > best[0]:
                best = likely, length, root, a
        _, self.length, self.root, self.weights = best

    def predict(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, deviation) of the score."""
        k = np.exp(-((points[:, None, :] - self.x[None, :, :]) ** 2).sum(2) / (2 * self.length**2))
        solved = np.linalg.solve(self.root, k.T)
        spread = np.sqrt(np.maximum(1.0 + NOISE - (solved**2).sum(0), 1e-12))
        return k @ self.weights * self.scale + self.mean, spread * self.scale


def improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """Expected excess over the best score so far."""
    z = (mean - best) / deviation
    share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))
    return (mean - best) * share + deviation * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def suggest(
    runs: DataFrame, score: str, space: Mapping[str, dict], n: int = 1, pool: int = 20_000, seed: int = 42, order: str | None = None,
    max_runs: int = 1000,
) -> DataFrame:
    """(a column per parameter, expected): the n most promising points. ``order`` names the column that tells later
    runs from earlier ones."""
    names, spark = list(space), runs.sparkSession
    places = F.array(*(_place(F.col(name), spec) for name, spec in space.items()))
    good = runs.select(places.alias("unit"), F.col(score).cast("double").alias("y"), *([F.col(order).alias("at")] if order else [F.lit(0).alias("at")]))
    good = good.filter(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf")) & ~F.exists("unit", lambda u: u.isNull()))
    half = max(max_runs // 2, 1)
    kept = {(tuple(r.unit), r.y) for part in (F.desc("y"), F.desc("at")) for r in good.orderBy(part, "unit").limit(half).collect()}
    pool_rows = candidates(spark, space, pool, seed)
    if not kept:
        return pool_rows.orderBy("candidate").limit(n).select(*names, F.lit(None).cast("double").alias("expected"))
    ordered = sorted(kept)
    x, y = np.array([u for u, _ in ordered]), np.array([v for _, v in ordered])
    process, best = Process(x, y), float(y.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                points = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                worth = improvement(*process.predict(points), best)
                taken = (np.abs(points[:, None, :] - x[None, :, :]).max(2) < 1e-9).any(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(taken, -1.0, worth))], ["candidate", "expected"])

    scored = pool_rows.select("candidate", "unit").mapInArrow(run, "candidate long, expected double")
    top = scored.filter("expected >= 0").orderBy(F.desc("expected"), "candidate").limit(n)
    return pool_rows.join(F.broadcast(top), "candidate").orderBy(F.desc("expected"), "candidate").select(*names, "expected")  # top: n rows


def search(
    spark: SparkSession, space: Mapping[str, dict], evaluate, runs: int, first: int = 5, seed: int = 42, pool: int = 20_000,
) -> list[tuple[dict, float]]:
    """Finished runs (point, score) in order: ``first`` points by hash, then each where the surrogate expects most.
    ``evaluate`` trains and scores a point, by whatever Spark jobs that takes."""
    names, done = list(space), []
    start = candidates(spark, space, first, seed).orderBy("candidate").select(*names).collect()
    for row in start[:runs]:
        point = row.asDict()
        done.append((point, float(evaluate(point))))
    while len(done) < runs:
        table = spark.createDataFrame([(*(p[k] for k in names), s, i) for i, (p, s) in enumerate(done)], [*names, "score", "at"])
        found = suggest(table, "score", space, 1, pool, seed + len(done), "at").collect()
        if not found:
            break
        point = {k: found[0][k] for k in names}
        done.append((point, float(evaluate(point))))
    return done

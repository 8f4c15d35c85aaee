import math

import numpy as np

from corpuslab.operators import sweep

SPACE = {"lr": {"min": 0.0, "max": 1.0}, "heads": {"values": [4, 8, 16]}, "epochs": {"min": 10, "max": 60, "int": True}}


def surface(p):
    """Greatest, 1.0, at lr 0.3, 8 heads, 40 epochs."""
    return math.exp(-((p["lr"] - 0.3) / 0.25) ** 2 - ((p["epochs"] - 40) / 15) ** 2) - (0.3 if p["heads"] != 8 else 0.0)


def test_candidates_lie_in_the_space(spark):
    rows = sweep.candidates(spark, SPACE, 3000).collect()
    assert {r.heads for r in rows} == {4, 8, 16} and {r.epochs for r in rows} == set(range(10, 61))
    assert all(0 <= u <= 1 for r in rows for u in r.unit) and 0.45 < np.mean([r.lr for r in rows]) < 0.55
    assert rows == sweep.candidates(spark, SPACE, 3000).collect()


def test_process_interpolates_and_knows_what_it_does_not():
    x = np.array([[0.0], [0.5], [1.0]])
    process = sweep.Process(x, np.array([0.0, 1.0, 0.2]))
    mean, deviation = process.predict(np.array([[0.5], [0.25], [5.0]]))
    assert abs(mean[0] - 1.0) < 0.01 and deviation[0] < deviation[1] <= deviation[2]
    assert abs(mean[2] - process.mean) < 0.05
    better = sweep.improvement(np.array([0.0, 1.0, 2.0, 1.0]), np.array([0.1, 0.1, 0.1, 0.5]), 1.0)
    assert better[0] < 1e-9 and abs(better[1] - 0.1 / math.sqrt(2 * math.pi)) < 1e-9 and abs(better[2] - 1.0) < 1e-6 and better[3] > better[1]


def test_finds_the_optimum_in_fewer_runs_than_the_grid(spark):
    grid = [{"lr": a / 7, "heads": h, "epochs": 10 + round(50 * e / 7)} for a in range(8) for h in (4, 8, 16) for e in range(8)]
    best_of_grid = max(map(surface, grid))
    done = sweep.search(spark, SPACE, surface, 24, first=6, pool=4000)
    assert len(done) == 24 < len(grid) / 4
    assert max(s for _, s in done) > max(best_of_grid - 0.03, 0.93)
    assert len({tuple(p.values()) for p, _ in done}) == 24


def test_odd_runs(spark):
    schema = "lr double, heads int, epochs int, score double"
    none = spark.createDataFrame([], schema)
    assert len(sweep.suggest(none, "score", SPACE, 2).collect()) == 2
    rows = spark.createDataFrame([(0.2, 8, 20, 0.5), (0.2, 8, 20, 0.5), (0.4, 16, 30, None), (0.4, 99, 30, 0.9), (0.5, 4, 30, float("nan")), (0.9, 4, 50, 0.1)], schema)
    found = sweep.suggest(rows, "score", SPACE, 3, pool=500).collect()
    assert len(found) == 3 and all(r.expected >= 0 for r in found)
    few = {"heads": {"values": [4, 8]}}
    assert {r.heads for r in sweep.suggest(spark.createDataFrame([(4, 1.0)], "heads int, score double"), "score", few, 1, pool=50).collect()} == {8}

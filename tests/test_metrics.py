import pytest

from corpuslab.operators import history, metrics


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame([("A", "A"), ("A", "C"), ("B", "B")], "y string, yhat string")


def test_accuracy_and_macro_f1(predictions):
    row = metrics.accuracy_f1(predictions).first()
    assert round(row.accuracy, 6) == 0.666667 and round(row.f1, 6) == 0.555556


def test_report(predictions):
    rows = {r.label: r for r in metrics.classification_report(predictions).collect()}
    assert rows["A"].recall == 0.5 and rows["A"].precision == 1.0 and rows["C"].support == 0
    assert round(rows["accuracy"].f1, 6) == 0.666667 and rows["accuracy"].precision is None
    assert round(rows["macro avg"].precision, 6) == 0.666667
    assert round(rows["weighted avg"].recall, 6) == 0.666667 and rows["weighted avg"].support == 3


def test_confusion(predictions):
    assert {(r.y, r.yhat): r.n for r in metrics.confusion(predictions).collect()} == {("A", "A"): 1, ("A", "C"): 1, ("B", "B"): 1}


def test_summary_rounds_half_to_even_and_first_best_split_wins(spark):
    df = spark.createDataFrame(
        [("r", 0, 0.125, 0.5, "p0"), ("r", 1, 0.125, 0.625, "p1")], "run string, split int, f1 double, accuracy double, params string"
    )
    row = metrics.run_summary(df, ["run"]).first()
    assert (row.best_f1, row.avg_f1, row.best_accuracy, row.avg_accuracy) == (0.12, 0.12, 0.62, 0.56)
    assert metrics.best_params(df, ["run"], "params").first().best_params == "p0"


def test_prediction_table(spark):
    df = spark.createDataFrame([("t", "A", "B", "g")], "t string, y string, yhat string, g string")
    row = metrics.prediction_table(df, "t", "g").first().asDict()
    assert row == {"original_text": "t", "predicted_label": "B", "original_label": "A", "predicted_text": "g"}


def stop_loop(losses, patience):
    best, waited = float("inf"), 0
    for epoch, loss in enumerate(losses):
        if loss < best:
            best, waited = loss, 0
        elif waited >= patience:
            return epoch
        else:
            waited += 1
    return None


def test_early_stop(spark):
    import random

    rng = random.Random(4)
    runs = {"fixture": [5, 4, 6, 6, 3, 7, 7, 7], "falling": [3, 2, 1]}
    runs.update({f"r{i}": [rng.randint(0, 30) for _ in range(rng.randint(1, 40))] for i in range(30)})
    rows = [(run, e, float(v)) for run, losses in runs.items() for e, v in enumerate(losses)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss double")
    got = {r.run: r.stop_epoch for r in history.early_stop(df, "run", "val_loss", 2).collect()}
    assert got == {run: stop_loop(losses, 2) for run, losses in runs.items()}
    assert got["fixture"] == 7


def test_curves(spark):
    df = spark.createDataFrame(
        [("r", s, e, v, v, v, v) for s, vs in ((0, [0.1, 0.5, 0.5]), (1, [0.2, 0.4])) for e, v in enumerate(vs)],
        "run string, split int, epoch int, train_f1 double, val_f1 double, train_accuracy double, val_accuracy double",
    )
    assert {r.split: r.best_epoch for r in history.best_epoch(df, ["split"]).collect()} == {0: 2, 1: 2}
    row = history.run_peaks(df, "run", "split").first()
    assert row.best_val_f1 == 0.5 and row.avg_val_f1 == 0.45
    runs = spark.createDataFrame([("b", 0.7), ("a", 0.7), ("c", 0.1)], "run string, avg_val_f1 double")
    assert history.leaderboard_best(runs).first().run == "a"


def test_means_at_a_tie_do_not_depend_on_the_order(spark):
    from itertools import permutations

    from pyspark.sql import functions as F

    runs = []
    for i, order in enumerate(permutations([0.985, 0.99, 1.0, 1.0, 1.0])):  # mean 0.995, rounds to even: 1.0
        runs += [(2 * i, s, v, 0.585) for s, v in enumerate(order)]
    for i, order in enumerate(permutations([0.96, 0.97, 0.98, 1.0, 0.965])):  # mean 0.975, rounds to even: 0.98
        runs += [(2 * i + 1, s, v, 0.575) for s, v in enumerate(order)]
    df = spark.createDataFrame(runs, "run int, split int, f1 double, accuracy double")
    for parts in (1, 3, 7):
        rows = metrics.run_summary(df.repartition(parts, F.rand(parts)), ["run"]).collect()
        assert {(r.run % 2, r.avg_f1, r.avg_accuracy) for r in rows} == {(0, 1.0, 0.58), (1, 0.98, 0.58)}
    lone = spark.createDataFrame([(x,) for x in (0.005, 0.015, 0.025, 0.285, 0.995, 1.0, 0.0, 0.1249)], "x double")
    got = [r[0] for r in lone.select(metrics.half_even(F.col("x"))).collect()]
    assert got == [0.0, 0.02, 0.02, 0.28, 1.0, 1.0, 0.0, 0.12]

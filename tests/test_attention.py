import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import attention as at
from corpuslab.operators import history


def brute_layer(x, edges, layer):
    z = x @ layer.w
    z3 = z.reshape(len(x), layer.heads, -1)
    s, t = (z3 * layer.a.reshape(layer.heads, -1)).sum(2), (z3 * layer.d.reshape(layer.heads, -1)).sum(2)
    out = np.zeros_like(z3)
    for v in range(len(x)):
        sources = [a for a, b in edges if b == v]
        q = s[sources] + t[v]
        e = np.where(q > 0, q, 0.2 * q)
        w = np.exp(e - e.max(0))
        out[v] = ((w / w.sum(0))[:, :, None] * z3[sources]).sum(0)
    return out.reshape(len(x), -1)


def brute_logits(x, edges, net):
    h = np.maximum(brute_layer(x, edges, net.first) + net.hidden_bias, 0)
    out = brute_layer(h, edges, net.second).reshape(len(x), net.second.heads, -1)
    return out.mean(1) + net.bias


def brute_loss(x, edges, net, y, train):
    logits = brute_logits(x, edges, net)
    e = logits - logits.max(1, keepdims=True)
    p = e - np.log(np.exp(e).sum(1, keepdims=True))
    return -np.mean([p[i, y[i]] for i in train])


def make(spark, n=14, features=5, models=(0, 1), seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)) * (rng.random((n, features)) < 0.6), 3)
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (3 * n, 2)) if a != b} | {(i, 3) for i in range(n) if i != 3}  # a hub
    y = rng.integers(0, 3, n)
    nodes = spark.createDataFrame(
        [(i, [int(j) for j in np.flatnonzero(v)], [float(v[j]) for j in np.flatnonzero(v)]) for i, v in enumerate(x)],
        "id long, idx array<int>, val array<double>")
    edges = spark.createDataFrame([*links, next(iter(links)), (2, 2)], "src long, dst long")
    graph = at.Graph.of(at.of_models(at.with_loops(nodes, edges), models, "src", "dst"))
    all_edges = sorted(links) + [(i, i) for i in range(n)]
    roles = [(m * at.MODEL + i, ["train", "train", "val", "test"][(i + m) % 4], int(y[i])) for m in models for i in range(n)]
    targets = spark.createDataFrame(roles, "id long, role string, y int")
    return x, all_edges, y, at.of_models(nodes, models, "id"), graph, targets


def nets_of(features=5, models=(0, 1)):
    nets = {m: at.Network.start(features, 3, hidden=4, heads=2, seed=m) for m in models}
    for m, net in nets.items():
        rng = np.random.default_rng(10 + m)
        net.hidden_bias, net.bias = rng.normal(size=4), rng.normal(size=3)
    return nets


def test_forward_against_brute_force(spark):
    x, edges, _, nodes, graph, _ = make(spark)
    graph = at.Graph(graph.edges, {0: 2, 5: 3}, {3: 3, at.MODEL + 3: 2})  # both joins split these keys
    nets = nets_of()
    rows = at.forward(graph, nodes, nets, [])["scores"].collect()
    assert len(rows) == 2 * len(x)
    want = {m: brute_logits(x, edges, net) for m, net in nets.items()}
    for r in rows:
        assert np.abs(np.array(r.logits) - want[r.id // at.MODEL][r.id % at.MODEL]).max() < 1e-9


def test_gradients_against_differences(spark):
    x, edges, y, nodes, graph, targets = make(spark)
    nets, keep = nets_of(), []
    made = at.forward(graph, nodes, nets, keep)
    lost = at.with_loss(made["scores"], targets)
    train = {m: [i for i in range(len(x)) if (i + m) % 4 < 2] for m in nets}
    got = at._gradients(graph, nodes, nets, made, lost, {m: len(t) for m, t in train.items()}, 2, 3)
    for m, net in nets.items():
        flat = net.flat()
        assert len(got[m]) == len(flat)
        for i in range(0, len(flat), 3):
            values = []
            for step in (1e-6, -1e-6):
                moved = flat.copy()
                moved[i] += step
                net.set(moved)
                values.append(brute_loss(x, edges, net, y, train[m]))
            net.set(flat)
            assert abs(got[m][i] - (values[0] - values[1]) / 2e-6) < 1e-5, (m, i)


def test_training_history_and_early_stop(spark):
    x, edges, y, nodes, graph, targets = make(spark, models=(0,))
    rows, best = at.train(graph, nodes, targets, nets_of(models=(0,)), epochs=6, patience=1, rate=0.1)
    table = spark.createDataFrame(rows, "run long, epoch int, train_loss double, val_loss double, train_f1 double, val_f1 double, train_accuracy double, val_accuracy double")
    assert [r[1] for r in rows] == list(range(len(rows))) and rows[1][2] < rows[0][2]
    stop = history.early_stop(table, "run", "val_loss", 1).first().stop_epoch
    assert stop == (len(rows) - 1 if len(rows) < 6 else stop)
    assert set(best) == {0} and len(best[0]) == len(nets_of(models=(0,))[0].flat())
    peaks = history.run_peaks(table.withColumn("split", F.lit(0)), "run", "split").first()
    assert peaks.best_val_f1 == max(r[5] for r in rows)

import numpy as np
from pyspark.sql import functions as F

from corpuslab.catalog import graph_queries
from corpuslab.operators import attention as at
from test_attention import make, nets_of


def test_the_query_trains_as_long_as_the_published_network():
    assert (graph_queries.ATTENTION_EPOCHS, graph_queries.ATTENTION_PATIENCE) == (8142, 1177)  # 3 and 2 before


def test_a_model_in_one_task_trains_as_in_passes(spark, monkeypatch):
    _, _, _, nodes, graph, targets = make(spark)
    graph = at.Graph(graph.edges.filter("NOT (src = 5 AND dst = 5)"), {}, {})
    nodes = nodes.filter(F.col("id") != 9)  # edges of a node without a row, and a node that only others reach
    targets = targets.filter(F.col("id") != 6)
    monkeypatch.setattr(at, "ALONE_STEP", 7)
    real, alone = at._Features.__init__, []
    for room in (1 << 20, 40, 0):  # all, some and no columns dense
        monkeypatch.setattr(at._Features, "__init__", lambda self, idx, val, width: real(self, idx, val, width, room))
        alone.append(at._train_alone(graph, nodes, targets, nets_of(), 2, 1, 0.1, 0.001))
    monkeypatch.setattr(at, "ALONE_EDGES", 0)
    passes, kept = at.train(graph, nodes, targets, nets_of(), 2, 1, 0.1, 0.001)
    for rows, best in alone:
        assert [r[:2] for r in rows] == [r[:2] for r in passes]
        assert np.abs(np.array(rows) - np.array(passes)).max() < 1e-9
        assert kept.keys() == best.keys() and all(np.abs(kept[m] - best[m]).max() < 1e-8 for m in best)


def test_no_job_per_epoch_for_small_models(spark, monkeypatch):
    _, _, _, nodes, graph, targets = make(spark)

    def passes(*args):
        raise AssertionError("a Spark pass per epoch")

    monkeypatch.setattr(at, "forward", passes)
    rows, _ = at.train(graph, nodes, targets, nets_of(), 40, 100)
    assert [r[:2] for r in rows] == [(m, e) for e in range(40) for m in (0, 1)]

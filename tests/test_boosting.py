from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from shotmetrics.operators import boosting


def _table(n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] * (x[:, 3] == 1))))
    y = (rng.random(n) < p).astype(float)
    return x, y


def _frame(spark, x, y):
    rows = [(i, Vectors.dense(list(map(float, r))), float(v), "clash") for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["shot_id", "features", "label", "bins"])


SETTINGS = {"rounds": 6, "depth": 3, "rate": 0.3, "lam": 1.0, "min_child_weight": 2.0, "row_share": 0.9, "column_share": 0.75, "seed": 5}


def _trees(model):
    return json.loads(model.getOrDefault(model.spec))


def test_numpy_twin_and_any_number_of_tasks(spark):
    x, y = _table()
    df = _frame(spark, x, y)
    one_task = boosting.fit(df, **SETTINGS, key="shot_id", bins=16)
    spread = {parts: boosting.fit(df, **SETTINGS, key="shot_id", bins=16, local_rows=0, parts=parts) for parts in (1, 8)}
    assert _trees(one_task) == _trees(spread[1]) == _trees(spread[8])
    # The same algorithm over NumPy arrays alone.
    spec = _trees(one_task)
    bins = boosting.binned(x, spec["edges"])
    rid = np.array([r.rid for r in spark.range(len(y)).selectExpr("xxhash64(id) AS rid").collect()], np.int64)
    n_bins = max(len(e) for e in spec["edges"]) + 1
    settings = [n_bins, *(SETTINGS[k] for k in ("rounds", "depth", "rate", "lam", "min_child_weight", "row_share", "column_share", "seed"))]
    twin = boosting.boost(bins, y, rid, spec["base"], lambda local: local, *settings)
    assert [t.as_dict() for t in twin] == spec["trees"]


def test_training_loss_falls_and_leaves_solve_their_equation():
    x, y = _table(800, seed=9)
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1]))) for f in range(x.shape[1])]
    bins = boosting.binned(x, edges)
    base = float(np.log(y.mean() / (1 - y.mean())))
    rid = np.arange(len(y), dtype=np.int64)
    n_bins = max(len(e) for e in edges) + 1
    trees = boosting.boost(bins, y, rid, base, lambda local: local, n_bins, 30, 3, 0.3, 1.0, 2.0, 1.0, 1.0, 1)
    margin, losses = np.full(len(y), base), []
    for t in trees:
        p = 1 / (1 + np.exp(-margin))
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        leaf = t.nodes(bins, 3)
        for node in np.unique(leaf):
            at = leaf == node
            g, h = (p - y)[at].sum(), (p * (1 - p))[at].sum()
            assert t.value[node] == pytest.approx(-0.3 * g / (h + 1.0), rel=1e-5, abs=1e-9)
            assert h >= 2.0 - 1e-6 or node == 0
        margin = margin + t.value[leaf]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:], strict=False))


def test_empty_frame_and_constant_features(spark):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([StructField("shot_id", LongType()), StructField("features", VectorUDT()), StructField("label", DoubleType())])
    empty = spark.createDataFrame([], schema)
    model = boosting.fit(empty, rounds=3, depth=2, rate=0.1)
    assert _trees(model)["trees"] == []
    x = np.zeros((50, 2))
    y = np.array([1.0] * 20 + [0.0] * 30)
    model = boosting.fit(_frame(spark, x, y), rounds=3, depth=2, rate=0.1, key="shot_id")
    scored = model.transform(_frame(spark, x, y)).select("probability").collect()
    # No feature splits: one leaf, so every row has the same score, near the mean label.
    found = {round(r.probability[1], 9) for r in scored}
    assert len(found) == 1 and abs(found.pop() - 0.4) < 0.01

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shotmetrics.catalog import QUERIES
from shotmetrics.catalog import modeling as catalog
from shotmetrics.operators import boosting
from shotmetrics.operators.lineage import checkpointed
from shotmetrics.sources.star_schema import shots


@pytest.fixture(scope="module")
def many_shots(spark, small_dir):
    """Some 46,000 shots: the smallest tables' ten times, with shifted keys."""
    copies = shots(spark, small_dir).crossJoin(spark.range(10).withColumnRenamed("id", "_k"))
    keys = {"shot_id": F.col("shot_id") + F.col("_k") * 10**7, "game_id": F.concat("game_id", F.lit("-"), F.col("_k").cast("string"))}
    return checkpointed(copies.withColumns(keys).drop("_k"))


@pytest.mark.parametrize("name", ["model_checks", "model_metrics", "score_boosted"])
def test_the_boosted_model_is_fitted_on_every_training_row(spark, many_shots, monkeypatch, name):
    plain, fits = boosting.fit, []

    def few_rounds(frame, **settings):
        model = plain(frame, **(settings | {"rounds": 1, "depth": 2}))
        fits.append((frame.count(), json.loads(model.getOrDefault(model.spec))["base"]))
        return model

    monkeypatch.setattr(boosting, "fit", few_rounds)
    monkeypatch.setattr(catalog, "_split", lambda *_: (many_shots, many_shots.limit(500)))
    monkeypatch.setattr(catalog, "_fitted", {})
    assert not QUERIES[name](spark, "patched").isEmpty()
    n, rate = many_shots.agg(F.count("*"), F.avg("shot_made_flag")).first()
    assert n > 40_000  # more were left out before
    assert fits == [(n, pytest.approx(math.log(rate / (1 - rate)), rel=1e-12))]


def _row_by_row(bins, y, rid, base, n_bins, rounds, depth, rate, row_share, column_share, seed):
    """Trees whose histograms are added one row at a time, without cells."""
    n_features, margin, trees = bins.shape[1], np.full(len(y), base), []
    for r in range(rounds):
        drawn = boosting.row_draw(rid, seed, r) < int(row_share * 2**32)
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * 2**boosting.SCALE_BITS).astype(np.int64) for v in (p - y, p * (1 - p)))

        def merged(tree, level, wanted, drawn=drawn, g=g, h=h):
            out = np.zeros((3, len(wanted), n_features, n_bins), np.int64)
            node = tree.nodes(bins, level)
            for i in np.flatnonzero(drawn & np.isin(node, wanted)):
                for f in range(n_features):
                    out[:, wanted.index(node[i]), f, bins[i, f]] += (g[i], h[i], 1)
            return out

        tree = boosting.grow(merged, n_features, n_bins, boosting.columns_of_round(n_features, column_share, seed, r), depth, rate, 1.0, 2.0)
        margin = margin + tree.value[tree.nodes(bins, depth)]
        trees.append(tree.as_dict())
    return trees


def test_cells_give_the_trees_of_single_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (900, 3)).astype(float)
    x[:400] = 2.0  # one cell with nearly half of the rows
    y = (rng.random(900) < 0.2 + 0.1 * x[:, 0]).astype(float)
    rows = [(i, Vectors.dense(list(map(float, r))), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, ["shot_id", "features", "label"])
    settings = {"rounds": 11, "depth": 2, "rate": 0.3, "row_share": 0.7, "column_share": 0.75, "seed": 3}
    monkeypatch.setattr(boosting, "TASK_ROWS", 60)  # deals the large cell to several tasks
    dealt = []
    for way in ("_boost_in_one_task", "_boost_over_tasks"):
        plain = getattr(boosting, way)
        monkeypatch.setattr(boosting, way, lambda state, *rest, plain=plain: dealt.append(state.select("n_cells").collect()) or plain(state, *rest))
    specs = [json.loads((m := boosting.fit(df, key="shot_id", local_rows=limit, **settings)).getOrDefault(m.spec)) for limit in (1000, 0)]
    edges, base = specs[0]["edges"], specs[0]["base"]
    bins = boosting.binned(x, edges)
    n_cells = len(np.unique(bins, axis=0))
    for parts in dealt:
        assert len(parts) > 4 and n_cells < sum(r.n_cells for r in parts) < n_cells + len(parts)
    rid = np.array([r.rid for r in spark.range(len(y)).selectExpr("xxhash64(id) AS rid").collect()], np.int64)
    want = _row_by_row(bins, y, rid, base, max(map(len, edges)) + 1, **settings)
    assert specs[0]["trees"] == want
    assert specs[1]["trees"] == want


def test_sums_beyond_the_whole_numbers_of_a_double_are_exact():
    values = np.array([2**53 + 1, -(2**55) - 3, 5, 2**60 + 7, -1], np.int64)
    index = np.array([0, 1, 0, 1, 2])
    got = boosting.exact_bincount(index, boosting.addends(values), 4)
    assert got.tolist() == [2**53 + 6, 2**60 - 2**55 + 4, -1, 0]

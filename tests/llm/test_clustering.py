from __future__ import annotations

import duckdb
import numpy as np
import pytest

from shotmetrics.llm import catalog, clustering


def test_transform_keeps_distances_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-2000, 2000, (50, 64))
    c = rng.integers(-2000, 2000, (8, 64))
    basis = clustering.walsh_basis()
    assert (basis @ basis.T == 64 * np.eye(64, dtype=np.int64)).all()
    changes = (np.diff(basis, axis=1) != 0).sum(axis=1)
    assert list(changes) == sorted(changes)
    vt, ct = clustering.transformed(v, basis), clustering.transformed(c, basis)
    full = ((vt[:, None, :] - ct[None, :, :]) ** 2).sum(axis=2)
    assert (full == 64 * ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)).all()


@pytest.mark.parametrize("spread", [3, 40, 3000])
def test_progressive_search_equals_brute_force(spread):
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread + 1, (400, 64))
    c = rng.integers(-spread, spread + 1, (8, 64))
    c[5] = c[2]  # equal centroids: the smaller number wins
    v[:10] = c[2]
    basis = clustering.walsh_basis()
    cluster, distance = clustering.nearest(clustering.transformed(v, basis), clustering.transformed(c, basis))
    d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    want = np.array([min(range(8), key=lambda j: (row[j], j)) for row in d])
    assert (cluster == want).all()
    assert (distance == d[np.arange(len(v)), want]).all()
    assert (cluster[:10] == 2).all()


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, cluster string")


def _oracle(spark, df):
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    out = con.execute(catalog.ORACLES["op12_centroids"]).df()
    out["vec_id"] = out["vec_id"].astype(object).where(out["vec_id"].notna(), None)
    return [(None if v is None else int(v), *rest) for v, *rest in out[["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]].itertuples(index=False)]


def test_small_table_equals_sql_with_awkward_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 64)], 0, "x", "y") for i in range(60)]
    rows += [(60, None, 1, None, None), (61, [0.1] * 63, 1, None, None), (62, [float("nan")] + [0.0] * 63, 1, None, None)]
    rows += [(63, [None] + [0.0] * 63, 1, None, None), (64, [float("inf")] + [0.0] * 63, 1, None, None)]
    rows += [(5, rows[5][1], 0, "again", None), (None, [0.25] * 64, 0, None, None)]  # a repeated row, a null id
    df = _frame(spark, rows)
    got = clustering.clustered(df).collect()
    ids = [r.vec_id for r in got]
    assert len(got) == 62 and ids.count(5) == 2 and None in ids
    assert not {60, 61, 62, 63, 64} & set(ids)
    mine = list((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(mine, key=key) == sorted(_oracle(spark, df), key=key)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}


def test_fewer_vectors_than_centroids_and_empty(spark):
    one = _frame(spark, [(1, [0.5] * 64, 0, None, None), (2, [0.5] * 64, 0, None, None)])
    rows = clustering.clustered(one).collect()
    assert [(r.distance, r.inertia) for r in rows] == [(0, 0), (0, 0)]
    assert len({r.cluster for r in rows}) == 1  # equal vectors: the smaller centroid number takes both
    assert clustering.clustered(_frame(spark, [])).count() == 0

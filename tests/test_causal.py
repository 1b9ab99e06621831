from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotmetrics.operators import bootstrap, causal
from shotmetrics.operators.lineage import checkpointed
from shotmetrics.plans.causal import causal_analysis


@pytest.fixture(scope="module")
def panel(scored_rows):
    return checkpointed(causal.player_season_panel(scored_rows, min_shots=8))


@pytest.fixture(scope="module")
def weighted(panel):
    complete = causal.complete_cases(causal.with_treatment(panel))
    return checkpointed(complete.withColumn("propensity_score", F.lit(0.02) + F.col("three_pt_rate")))


def test_panel_lags_the_row_before(panel):
    p = panel.toPandas().sort_values(["player_id", "season_type", "season"])
    want = p.groupby(["player_id", "season_type"]).avg_xfg.shift(1)
    assert np.allclose(p.prior_avg_xfg.astype(float), want, equal_nan=True)


def test_treatment_quantile(panel):
    p = panel.toPandas()
    got = causal.with_treatment(panel).toPandas()
    assert got.treatment.sum() == (p.avg_xfg >= p.avg_xfg.quantile(0.667)).sum()


def test_ipw_point_equals_numpy(weighted):
    w = weighted.toPandas()
    ps = w.propensity_score.clip(0.05, 0.95)
    t = w.treatment == 1
    want = np.average(w.actual_pps[t], weights=1 / ps[t]) - np.average(w.actual_pps[~t], weights=1 / (1 - ps[~t]))
    row = causal.ipw_point(weighted).first()
    assert row.ate == pytest.approx(want, abs=1e-7)
    assert (row.n_treated, row.n_control) == (t.sum(), (~t).sum())


def test_bootstrap_mean_has_the_right_spread(spark):
    rows = spark.range(400).select("id", (F.col("id") * 7919 % 101).cast("double").alias("y"))
    sums = bootstrap.replicate_sums(rows, ["id"], {"y": F.col("y"), "n": F.lit(1.0)}, replicates=402)
    means = sums.select((F.col("y") / F.col("n")).alias("m"), "n")
    got = means.toPandas()
    assert len(got) == 402
    y = rows.toPandas().y
    assert got.n.mean() == pytest.approx(400, rel=0.02)
    assert got.m.std() == pytest.approx(y.std(ddof=0) / 20, rel=0.15)
    again = bootstrap.replicate_sums(rows.repartition(5), ["id"], {"y": F.col("y")}, replicates=402)
    assert dict(sums.select("replicate", "y").collect()) == dict(again.collect())


def test_ipw_effect_row(weighted):
    row = causal.ipw_effect(weighted, replicates=200).first()
    assert row.se > 0 and row.ci_lower < row.ate < row.ci_upper
    assert row.p_value == pytest.approx(math.erfc(abs(row.ate / row.se) / math.sqrt(2)), abs=2e-3)


def test_did_equals_pandas(panel):
    p = panel.toPandas().sort_values(["player_id", "season_type", "season"])
    by = ["player_id", "season_type"]
    p["delta"] = p.groupby(by).avg_xfg.diff()
    p = p.dropna(subset=["delta"]).copy()
    half = p.delta.std() * 0.5
    p["t"], p["c"] = p.delta >= half, p.delta.abs() < half
    p["before"] = p.groupby(by).actual_pps.shift(1)
    pre = p.dropna(subset=["before"])
    want = (p[p.t].actual_pps.mean() - pre[pre.t].before.mean()) - (p[p.c].actual_pps.mean() - pre[pre.c].before.mean())
    row = causal.difference_in_differences(panel, replicates=100).first()
    assert row.did_estimate == pytest.approx(want, abs=1e-5)
    assert (row.n_treated, row.n_control) == (p.t.sum(), p.c.sum())
    assert row.message is None and row.se > 0


def test_did_without_pairs(panel):
    row = causal.difference_in_differences(panel.limit(1), replicates=20).first()
    assert row.did_estimate is None and row.n_treated == 0 and row.message.startswith("Insufficient")


def _rank_sum_p(x, y):
    both = pd.Series(np.concatenate([x, y])).rank()
    n1, n2 = len(x), len(y)
    z = (both[:n1].sum() - n1 * (n1 + n2 + 1) / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return math.erfc(abs(z) / math.sqrt(2))


def test_sensitivity_equals_ranks(weighted):
    w = weighted.toPandas()
    x, y = w.actual_pps[w.treatment == 1].to_numpy(), w.actual_pps[w.treatment == 0].to_numpy()
    table = causal.sensitivity_table(weighted).orderBy("gamma").collect()
    assert [r.gamma for r in table] == [1 + 0.25 * i for i in range(9)]
    for r in table:
        want = _rank_sum_p(x * (1 / r.gamma), y)
        assert r.p_upper == pytest.approx(want, abs=6e-5)
        assert r.significant == (want < 0.05)
    summary = causal.sensitivity_summary(causal.sensitivity_table(weighted)).first()
    first = next((r.gamma for r in table if not r.significant), None)
    assert summary.gamma_break == first and "gamma = " in summary.interpretation


def test_sensitivity_needs_five_per_arm(weighted):
    few = weighted.where("treatment = 0").unionByName(weighted.where("treatment = 1").limit(4))
    table = causal.sensitivity_table(few)
    assert table.isEmpty()
    assert causal.sensitivity_summary(table).first().interpretation.startswith("Too few")


def test_propensity_scores_are_stationary(panel):
    """At the optimum the penalised gradient vanishes."""
    rows = causal.propensity_scores(panel).toPandas()
    z = rows[causal.CONFOUNDERS].astype(float)
    z = (z - z.mean()) / z.std(ddof=0)
    score = rows.propensity_score
    assert abs((score - rows.treatment).mean()) < 1e-4
    logit = np.log(score / (1 - score))
    design = np.column_stack([np.ones(len(z)), z])
    beta = np.linalg.lstsq(design, logit, rcond=None)[0]
    gradient = z.T @ (score - rows.treatment) + beta[1:]
    assert np.abs(gradient).max() < 0.05


def test_whole_analysis(scored_rows):
    result = causal_analysis(scored_rows, min_shots=8, replicates=40)
    assert result.ipw.count() == result.did.count() == result.sensitivity_summary.count() == 1
    assert result.sensitivity.count() == 9
    means = causal.did_means(causal.did_stack(causal.did_groups(result.panel)))
    assert causal.parallel_trends(means).count() == 2

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shotmetrics.functions import court
from shotmetrics.operators import spatial
from shotmetrics.operators.features import with_made_minus_expected

ZONES = [
    (-220, 140, "corner3_left"),
    (220, 140, "corner3_right"),
    (-220, 140.5, "three_left"),
    (0, 80, "restricted"),
    (48, 64, "restricted"),
    (0, 81, "paint_center"),
    (-26.67, 100, "paint_center"),
    (-26.68, 100, "paint_left"),
    (80, 190, "paint_right"),
    (80, 190.5, "mid_right_center"),
    (100, 0, "mid_right"),
    (100, -40, "mid_right"),
    (0, 200, "mid_center"),
    (0, 237.5, "mid_center"),
    (0, 238, "three_center"),
    (-150, 100, "mid_left"),
    (-100, 170, "mid_left_center"),
    (200, 200, "three_right"),
    (250.1, 0, None),
    (0, 422.5, "three_center"),
    (0, 422.6, None),
    (0, -47.5, "restricted"),
    (0, -47.6, None),
    (None, 5, None),
]


def test_zone_boundaries(spark):
    rows = spark.createDataFrame([(None if x is None else float(x), float(y), z) for x, y, z in ZONES], "loc_x double, loc_y double, want string")
    got = spatial.with_zone(rows).collect()
    assert [(r.loc_x, r.loc_y, r.zone_id) for r in got] == [(r.loc_x, r.loc_y, r.want) for r in got]
    direct = rows.select(court.zone_id(F.col("loc_x"), F.col("loc_y")).alias("z"), "want").collect()
    assert all(r.z == r.want for r in direct)


def test_distance_buckets(spark):
    cases = {-0.1: None, 0.0: "0-8 ft", 7.9: "0-8 ft", 8.0: "8-16 ft", 16.0: "16-24 ft", 24.0: "24-35 ft", 35.0: "35+ ft", 99.9: "35+ ft", 100.0: None}
    rows = spark.createDataFrame(list(cases.items()), "d double, want string")
    assert all(r.b == r.want for r in rows.select(court.distance_bucket(F.col("d")).alias("b"), "want").collect())


def test_angle_buckets(spark):
    cases = {-181.5: None, -181.0: "Far Left", -120.0: "Far Left", -119.0: "Left Wing", -20.0: "Left", -19.9: "Center", 20.0: "Center", 60.0: "Right", 120.0: "Right Wing", 180.0: "Far Right", 181.5: None}
    rows = spark.createDataFrame(list(cases.items()), "d double, want string")
    assert all(r.b == r.want for r in rows.select(court.angle_bucket(F.col("d")).alias("b"), "want").collect())


def test_cohorts(spark):
    rows = spark.createDataFrame(
        [(5.0, "Center(C)", "at_rim", "straight_on"), (10.0, "LEFT side", "short_mid", "left_side"), (18.0, "Right(R)", "mid_range", "right_side"), (None, None, "long_range", "other")],
        "d double, a string, wd string, wa string",
    )
    for r in rows.select(court.distance_cohort(F.col("d")).alias("gd"), court.angle_cohort(F.col("a")).alias("ga"), "wd", "wa").collect():
        assert (r.gd, r.ga) == (r.wd, r.wa)


def _hex_by_hand(x, y):
    pad = 1e-9 * 500
    sx, sy = (500 + 2 * pad) / 34, 470 / 19
    u, v = (x + 250 + pad) / sx, (y + 47.5) / sy
    best = None
    for lattice, shift, ni, nj in (("A", 0.0, 35, 20), ("B", 0.5, 34, 19)):
        i = round(u) if lattice == "A" else math.floor(u)
        j = round(v) if lattice == "A" else math.floor(v)
        d = (u - i - shift) ** 2 + 3 * (v - j - shift) ** 2
        cell = (lattice, i, j) if 0 <= i < ni and 0 <= j < nj else None
        if best is None or d <= best[0]:
            best = (d, cell)
    return best[1]


def test_hexagons_against_brute_force(scored_rows, scored_pandas):
    want = {}
    for x, y in zip(scored_pandas.loc_x, scored_pandas.loc_y, strict=True):
        cell = _hex_by_hand(x, y)
        if cell:
            want[cell] = want.get(cell, 0) + 1
    got = {(r.lattice, r.i, r.j): r.attempts for r in spatial.hex_map(scored_rows).collect()}
    assert got == want


def test_zone_map_needs_attempts_of_all_shots(spark):
    rows = spark.createDataFrame([(0.0, 10.0, 0.5)] + [(0.0, 10.0, None)] * 5 + [(0.0, 200.0, 0.4)] * 5, "loc_x double, loc_y double, p_make double")
    got = {r.zone_id: (r.attempts, r.value) for r in spatial.zone_map(rows, "quality").collect()}
    assert got == {"restricted": (6, 0.5)}
    full = {r.zone_id: r.value for r in spatial.every_zone(spatial.zone_map(rows, "quality")).collect()}
    assert len(full) == 14 and full["restricted"] == 0.5 and full["mid_left"] is None


def test_value_ranges(spark):
    values = spark.createDataFrame([(-0.1,), (0.3,)], "value double")
    assert tuple(spatial.value_range(values, center_zero=True).first()) == (-0.3, 0.3)
    assert tuple(spatial.value_range(values).first()) == (-0.1, 0.3)
    assert tuple(spatial.value_range(values, low=0.2, high=0.8).first()) == (0.2, 0.8)
    flat = spark.createDataFrame([(0.5,), (0.5,)], "value double")
    assert tuple(spatial.value_range(flat).first()) == (0.5, 0.5 + 1e-6)
    assert spatial.value_range(values.where("value > 9")).isEmpty()


def test_location_table_against_pandas(scored_rows, scored_pandas):
    import numpy as np
    import pandas as pd

    f = scored_pandas.copy()
    f["mme"] = f.shot_made_flag - f.p_make
    f["d"] = pd.cut(f.shot_distance, bins=court.DISTANCE_EDGES, labels=court.DISTANCE_LABELS, right=False)
    f["a"] = pd.cut(np.degrees(np.arctan2(f.loc_y, f.loc_x)), bins=court.ANGLE_EDGES, labels=court.ANGLE_LABELS, include_lowest=True)
    want = f.groupby(["d", "a"], observed=False).agg(n=("mme", "size"), smoe=("mme", "mean")).reset_index()
    got = spatial.location_buckets(scored_rows, min_attempts=0).toPandas()
    assert len(got) == len(want) == 35
    both = want.merge(got, left_on=["d", "a"], right_on=["distance_bucket", "angle_bucket"])
    assert (both.n == both.attempts).all()
    assert np.allclose(both.smoe_x * 100, both.smoe_y, equal_nan=True, atol=1e-6)
    spots = spatial.best_and_worst(spatial.location_buckets(scored_rows)).collect()
    best = [r.smoe for r in spots if r.segment == "Best Spots"]
    assert len(best) == 5 and best == sorted(best, reverse=True)


def test_made_minus_expected_is_null_when_unscored(spark):
    rows = spark.createDataFrame([(1, None), (1, 0.25)], "shot_made_flag int, p_make double")
    assert [r.made_minus_expected for r in with_made_minus_expected(rows).collect()] == [None, 0.75]


@pytest.mark.parametrize("kind", ["frequency", "smoe"])
def test_zone_counts_cover_the_half_court(scored_rows, scored_pandas, kind):
    rows = with_made_minus_expected(scored_rows)
    inside = scored_pandas.loc_x.between(-250, 250) & scored_pandas.loc_y.between(-47.5, 422.5)
    assert spatial.zone_map(rows, kind).agg(F.sum("attempts")).first()[0] == inside.sum()


def test_distance_falls_back_to_the_coordinates(spark):
    rows = spark.createDataFrame([(0.0, 170.0, None, 1, 0.5), (0.0, 170.0, 30.0, 1, 0.5)], "loc_x double, loc_y double, shot_distance double, shot_made_flag int, p_make double")
    got = spatial.with_location_buckets(rows).collect()
    assert [r.distance_bucket for r in got] == ["16-24 ft", "24-35 ft"]
    assert {r.angle_bucket for r in got} == {"Right Wing"}

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from shotmetrics.functions import court, numeric, seasons
from shotmetrics.operators import features
from shotmetrics.schema import SHOT_COLUMNS, conform

GEOMETRY = "loc_x double, loc_y double, shot_distance double, shot_type string"


def test_distance_and_angle(spark):
    rows = spark.createDataFrame([(3.0, 4.0, 5.0, "2PT Field Goal"), (-3.0, 4.0, 24.0, "3PT Field Goal")], GEOMETRY)
    a, b = features.with_features(rows).orderBy(F.col("loc_x").desc()).collect()
    assert a.distance == pytest.approx(5.0)
    assert a.angle == pytest.approx(math.atan2(4, 3))
    assert b.angle == pytest.approx(math.atan2(4, -3))
    assert (a.is_3, b.is_3) == (0, 1)
    assert a.shot_zone_basic == "Unknown"


def test_three_point_inference(spark):
    schema = GEOMETRY + ", shot_zone_basic string, shot_zone_range string"
    rows = spark.createDataFrame(
        [
            (0.0, 0.0, 10.0, "2PT Field Goal", "Mid-Range", "8-16 ft."),
            (230.0, 60.0, 22.0, "2PT Field Goal", "Right Corner 3", "24+ ft."),
            (0.0, 0.0, 25.0, "2PT Field Goal", "Above the Break 3", "24+ ft."),
        ],
        schema,
    )
    assert [r[0] for r in rows.select(court.inferred_three(rows)).collect()] == [0, 1, 1]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ((230.0, 60.0, 22.0, None), 1),
        ((230.0, 141.0, 22.0, None), 0),
        ((219.0, 60.0, 22.0, None), 0),
        ((0.0, 0.0, 23.75, None), 1),
        ((0.0, 0.0, 23.7, None), 0),
        ((0.0, 0.0, None, "3pt field goal"), 1),
        ((None, None, None, None), 0),
    ],
)
def test_three_point_geometry(spark, row, expected):
    rows = spark.createDataFrame([row], GEOMETRY)
    assert rows.select(court.inferred_three(rows)).first()[0] == expected


def test_season_options(spark):
    found = [r.season for r in seasons.season_options_on(spark, date(2026, 2, 26)).collect()]
    assert (found[0], found[-1], len(found)) == ("1996-97", "2025-26", 30)
    rolled = seasons.season_options_on(spark, date(2026, 9, 2)).collect()
    assert rolled[-1].season == "2026-27"
    assert [r.season for r in rolled if r.is_default] == ["2025-26"]
    early = seasons.season_options_on(spark, date(2001, 1, 1)).collect()
    assert [r.season for r in early if r.is_default] == ["2000-01"]


def test_season_names():
    assert seasons.normalize_season(2025) == seasons.normalize_season("2025") == "2025-26"
    assert seasons.normalize_season("1999-00") == "1999-00"


def test_lenient_numbers(spark):
    rows = spark.createDataFrame(
        [("5", 5.0), (" 5 ", 5.0), ("abc", None), ("", None), ("5d", None), ("1e3", 1000.0), ("NaN", None), (None, None)],
        "s string, want double",
    )
    got = rows.select(numeric.lenient_double(rows, "s"), "want").collect()
    assert [g for g, _ in got] == [w for _, w in got]
    assert rows.select(numeric.lenient_double(rows, "absent")).distinct().collect() == [(None,)]


def test_rounding_halves_away_from_zero(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (0.25,), (None,)], "x double")
    assert [r[0] for r in rows.select(numeric.round_half_away(F.col("x"), 0)).collect()] == [3.0, -3.0, 0.0, None]


def test_exact_mean_does_not_depend_on_partitions(spark):
    base = spark.range(20000).withColumn("p", (F.col("id") * 7919 % 10007) / F.lit(10007.0))
    means = {
        base.repartition(n).agg(numeric.exact_mean(F.col("p")).alias("m")).first().m for n in (1, 3, 7)
    }
    assert len(means) == 1
    assert means.pop() == pytest.approx(base.agg(F.avg("p")).first()[0], abs=1e-9)


def test_exact_mean_of_negatives_and_nan(spark):
    rows = spark.createDataFrame([(-0.25,), (0.75,), (float("nan"),), (None,)], "x double")
    assert rows.agg(numeric.exact_mean(F.col("x"))).first()[0] == 0.25
    assert rows.where("x > 5 and not isnan(x)").agg(numeric.exact_mean(F.col("x"))).first()[0] is None


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(numeric.clip(F.col("x"), 0.05, 0.95)).collect()] == [0.05, 0.5, 0.95, None]


@pytest.mark.parametrize("z", [0.0, 0.5, -1.0, 1.96, 3.0, 6.0])
def test_two_sided_p(spark, z):
    got = spark.range(1).select(numeric.two_sided_p(F.lit(z))).first()[0]
    assert got == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)


def test_conform_fills_orders_and_cleans(spark):
    rows = spark.createDataFrame([("x", float("nan"), 3.0)], "extra string, shot_distance double, loc_x double")
    out = conform(rows)
    assert out.columns == SHOT_COLUMNS
    row = out.first()
    assert (row.shot_distance, row.loc_x, row.season) == (None, 3.0, None)


def test_model_matrix_aligns_to_frozen_columns(spark):
    schema = GEOMETRY + ", shot_zone_basic string, shot_made_flag int"
    train = spark.createDataFrame([(1.0, 1.0, 1.0, "x", "A", 1), (1.0, 1.0, 1.0, "x", None, 0)], schema)
    columns = features.one_hot_levels(train)
    assert columns[5:] == [
        "shot_zone_basic_A", "shot_zone_basic_Unknown", "shot_zone_area_Unknown", "shot_zone_range_Unknown",
    ]
    new = spark.createDataFrame([(None, 2.0, 1.0, "x", "B", None)], schema)
    row = features.model_matrix(new, columns).first()
    assert (row.loc_x, row.distance, row["shot_zone_basic_A"], row["shot_zone_basic_Unknown"], row.label) == (0.0, 0.0, 0, 0, 0)


def test_ml_vector_is_empty_for_unseen_level(spark):
    schema = GEOMETRY + ", shot_zone_basic string"
    train = spark.createDataFrame([(1.0, 1.0, 1.0, "x", z) for z in "AB"], schema)
    new = spark.createDataFrame([(0.0, 0.0, 0.0, "x", "A"), (0.0, 0.0, 0.0, "x", "C")], schema)
    fitted = features.feature_stages().fit(features.model_frame(train))
    rows = fitted.transform(features.model_frame(new)).collect()
    assert [r.shot_zone_basic_onehot.numNonzeros() for r in rows] == [1, 0]


def test_split_keeps_groups_together(scored_rows):
    marked = features.with_split(scored_rows.withColumn("game_id", F.when(F.col("player_id") != 3, F.col("game_id"))))
    mixed = marked.groupBy(features.split_group(marked)).agg(F.count_distinct("is_test").alias("n")).where("n > 1")
    assert mixed.isEmpty()
    share = marked.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.15 < share < 0.25

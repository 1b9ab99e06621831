from __future__ import annotations

import math

import pytest

from shotmetrics.operators.features import with_split


@pytest.mark.parametrize("n_groups", [1, 5, 15, 101, 3000])
def test_exact_number_of_test_groups(spark, n_groups):
    rows = [(i, f"g{i % n_groups}", i % 7) for i in range(3 * n_groups)] + [(-1, None, 3), (-2, None, 4)]
    df = spark.createDataFrame(rows, "shot_id long, game_id string, player_id long")
    marked = with_split(df).collect()
    groups = {}
    for r in marked:
        key = r.game_id if r.game_id is not None else f"{r.player_id}_missing_game"
        assert groups.setdefault(key, r.is_test) == r.is_test  # one decision per group
    assert sum(groups.values()) == math.ceil(0.2 * len(groups))
    assert len(marked) == len(rows)

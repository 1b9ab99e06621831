"""The causal job: from scored shots to the three estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.causal import (
    difference_in_differences,
    ipw_effect,
    player_season_panel,
    propensity_scores,
    sensitivity_summary,
    sensitivity_table,
)
from ..operators.lineage import checkpointed


@dataclass(frozen=True)
class CausalResult:
    panel: DataFrame
    scored_panel: DataFrame
    ipw: DataFrame
    did: DataFrame
    sensitivity: DataFrame
    sensitivity_summary: DataFrame


def causal_analysis(scored: DataFrame, min_shots: int = 50, replicates: int = 500) -> CausalResult:
    """Panel, weighting, difference in differences and sensitivity in one go."""
    panel = checkpointed(player_season_panel(scored, min_shots))
    weighted = checkpointed(propensity_scores(panel))
    table = sensitivity_table(weighted)
    return CausalResult(
        panel=panel,
        scored_panel=weighted,
        ipw=ipw_effect(weighted, replicates),
        did=difference_in_differences(panel, replicates),
        sensitivity=table,
        sensitivity_summary=sensitivity_summary(table),
    )

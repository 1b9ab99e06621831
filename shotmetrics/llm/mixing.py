"""Mixing sources to target weights by hierarchical budgets.

The token budget runs down a tree such as domain, language, source. At each
node it is split among the children by weight; a child that has too few tokens
gives its rest to its siblings, and only what all of them cannot hold is left
to the node's own siblings, because a node never gets more than its subtree
holds. Each leaf then takes its documents in seeded epochs, in each epoch as
far as the tokens of its share reach.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, whole_text

# Hex digits of the order that split a leaf's running sum into parts: 4,096 tasks for one leaf.
PART_DIGITS = 3


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD_PATTERN)).cast("bigint")


def _weight(levels: Sequence[str], weights: Mapping[str, int]) -> Column:
    """Weight of a node: by its whole path, else by its last part under '*', else 1."""
    if not weights:
        return F.lit(1).cast("bigint")
    given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    path = F.concat_ws("/", *levels)
    any_parent = F.concat_ws("/", *[F.lit("*")] * (len(levels) - 1), levels[-1])
    return F.coalesce(F.try_element_at(given, path), F.try_element_at(given, any_parent), F.lit(1)).cast("bigint")


def split_budget(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share of each child, from its cap and weight and its parent's budget.

    Children that their fair share would overfill are filled in the order of
    cap by weight; the others divide the rest by weight, rounded down.
    """
    wide = "decimal(19,0)"
    siblings = Window.partitionBy(*parent)
    before = siblings.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    cap, weight, budget = (F.col(c).cast(wide) for c in ("cap", "weight", "budget"))
    room = budget - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(wide)
    heft = (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(wide)
    marked = nodes.withColumn("full", cap * heft <= room * weight)
    full_cap = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    summed = marked.withColumn("rest", F.col("budget") - full_cap).withColumn("open_weight", open_weight)
    divided = F.expr("(cast(rest as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(open_weight as decimal(19,0))")
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), divided))
    return summed.withColumn("share", share.cast("bigint")).drop("full", "rest", "open_weight")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, int], budget: tuple[int, int], epochs: int
) -> DataFrame:
    """Budget of every leaf: levels, tokens (one epoch's) and quota.

    leaves has the levels and tokens; budget is the share of all tokens, as
    numerator and denominator. Weights are keyed by path ("web", "web/en") or
    by name under any parent ("*/en").
    """
    capped = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = capped.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum("cap"), F.lit(0)).alias("all_caps"))
    whole = F.expr(f"(all_tokens * {budget[0]}) div {budget[1]}")
    parent: list[str] = []
    budgets = total.select(F.least(whole, "all_caps").alias("budget"))
    for i, name in enumerate(levels):
        here = [*parent, name]
        nodes = capped.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(here, weights))
        nodes = nodes.join(budgets, parent) if i else nodes.crossJoin(F.broadcast(budgets))  # one row
        budgets = split_budget(nodes, parent or [F.lit(0)], name).select(*here, F.col("share").alias("budget"))
        parent = here
    return budgets.join(leaves, list(levels)).select(*levels, "tokens", F.col("budget").alias("quota"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Mapping[str, int],
    budget: tuple[int, int] = (1, 2),
    epochs: int = 2,
    seed: int = 17,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The chosen rows as (row, the levels, epoch, n_tokens, quota), row being the whole input row.

    levels names the tree's levels, from the top, with the SQL expression that
    gives each. A null level is a branch named ''. Tokens are words; null and empty
    texts have none and are taken as long as their epoch's prefix reaches them.
    Rows with equal keys follow each other in the order. With more than one
    epoch a document can come once in each. An empty table gives no rows; the
    rounding leaves less than one token per node unspent. Input columns may
    have any names, as they stay inside row.
    """
    names = list(levels)
    rows = docs.select(
        F.struct("*").alias("row"),
        *[F.coalesce(F.expr(sql).cast("string"), F.lit("")).alias(n) for n, sql in levels.items()],
        n_words().alias("n_tokens"),
    )
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    quotas = leaf_budgets(leaves, names, weights, budget, epochs)
    shares = (
        quotas.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("reach", F.least("tokens", F.col("quota") - F.col("epoch") * F.col("tokens")))
        .filter((F.col("reach") > 0) | (F.col("epoch") == 0))
    )
    dealt = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key_text = F.concat_ws(":", F.lit(seed), "epoch", *[F.coalesce(F.col(f"row.{k}").cast("string"), F.lit("")) for k in keys])
    dealt = dealt.withColumn("order", F.md5(key_text)).withColumn("part", F.substring("order", 1, PART_DIGITS))
    by_part = [*names, "epoch", "part"]
    earlier = Window.partitionBy(*names, "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        dealt.groupBy(*by_part)
        .agg(F.sum("n_tokens").alias("part_tokens"))
        .withColumn("before", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)))
        .join(shares.select(*names, "epoch", "reach", "quota"), [*names, "epoch"])
        .filter(F.col("before") <= F.col("reach"))
        .select(*by_part, "before", "reach", "quota")
    )
    running = Window.partitionBy(*by_part).orderBy("order", *[F.col(f"row.{k}") for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.join(parts, by_part)
        .withColumn("reached", F.col("before") + F.sum("n_tokens").over(running))
        .filter(F.col("reached") <= F.col("reach"))
        .select("row", *names, "epoch", "n_tokens", "quota")
    )

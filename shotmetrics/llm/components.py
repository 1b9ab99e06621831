"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id of the links (a, b) with the smallest id it reaches.

    Repeated, reversed and looping links are allowed; an empty table gives an
    empty one. Each round shrinks all paths at once, so rounds grow with the
    logarithm of the longest path. A hub is one key of partial aggregates and
    of a join that can be split, never one group.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    pairs = checkpointed(pairs)
    before = _state(pairs)
    while before[0]:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.filter("a > b").distinct())
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(small.union(roots.select("a", F.col("m").alias("b"))).distinct())
        after = _state(pairs)
        if after == before:
            break
        before = after
    ids = pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return ids.union(pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(
        F.min("component").alias("component")
    )

"""Uniform shuffle into shards of exact size.

Rows fall into blocks by a hash of their key. A matrix of exact block-to-shard
counts is drawn from the multivariate hypergeometric law, so the shard sizes
hold before any row moves. Each block is permuted locally and cut by its row of
the matrix; the rows are exchanged; each shard is permuted again. Every order
of the rows is equally likely under the seeded hash.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parallel_parts

ROWS_PER_BLOCK = 250_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of the draws, without replacement, are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mass = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - mass
    up, down, up_mass, down_mass = mode, mode, mass, mass
    while left > 0 and (up < high or down > low):
        if up < high:
            up_mass *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= up_mass
            if left <= 0:
                return up
        if down > low:
            down_mass *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= down_mass
            if left <= 0:
                return down
    return mode


def communication_matrix(block_rows: Sequence[int], shard_rows: Sequence[int], seed: int) -> list[list[int]]:
    """Rows each block sends to each shard; margins are the given counts."""
    rng = random.Random(seed)
    room, matrix = list(shard_rows), []
    for rows in block_rows:
        free, line = sum(room), []
        for j, places in enumerate(room):
            free -= places
            taken = hypergeometric(rng, places, free, rows)
            line.append(taken)
            room[j] -= taken
            rows -= taken
        matrix.append(line)
    return matrix


def even_sizes(rows: int, shards: int, seed: int) -> list[int]:
    """Sizes at most one apart; the seed picks who gets one more."""
    extra = set(random.Random(seed).sample(range(shards), rows % shards))
    return [rows // shards + (j in extra) for j in range(shards)]


def _hash(seed: int, salt: str, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(f"row.{k}") for k in keys])


def uniform_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 17,
    keys: Sequence[str] = ("doc_id",),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The rows with shard (0-based) and slot (gapless place in the shard), counts at most one apart.

    keys name the columns whose values decide a row's place. Null keys and
    empty or very long texts are placed like any others; rows with equal keys
    get neighbouring places of the local order and may be told apart by no one.
    An empty table gives an empty result, a table with fewer rows than shards
    leaves shards empty. Columns named shard or slot are replaced. The driver
    holds one count per block and shard, with a block per 250,000 rows or
    shuffle partition.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    spark = docs.sparkSession
    total = docs.count()
    blocks = max(1, math.ceil(total / rows_per_block), min(parallel_parts(spark), total))
    cells = max(1, math.ceil(blocks / shards))
    slim = docs.select(F.struct(*keys).alias("row"))
    rows = docs.select(F.struct(*kept).alias("row"))

    block = F.pmod(_hash(seed, "block", keys), F.lit(blocks)).cast("int")
    counted = {r["block"]: r["n"] for r in slim.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()}
    sizes = even_sizes(total, shards, seed)
    matrix = communication_matrix([counted.get(b, 0) for b in range(blocks)], sizes, seed)
    cuts = []
    for b, line in enumerate(matrix):
        ends, reached = [], 0
        for taken in line:
            reached += taken
            ends.append(reached)
        cuts.append((b, ends))
    cut_table = F.broadcast(spark.createDataFrame(cuts, "block int, ends array<bigint>"))

    def dealt(frame: DataFrame) -> DataFrame:
        # The whole row's hash last: rows equal on the keys are then dealt alike on every run.
        local = Window.partitionBy("block").orderBy(_hash(seed, "local", keys), *[F.col(f"row.{k}") for k in keys], F.xxhash64("row"))
        placed = frame.withColumn("block", block).withColumn("place", F.row_number().over(local))
        shard = F.size(F.filter("ends", lambda end: end < F.col("place")))
        order = _hash(seed, "shard", keys)
        return placed.join(cut_table, "block").select(
            "row", shard.alias("shard"), F.pmod(order, F.lit(cells)).cast("int").alias("cell"), order.alias("order")
        )

    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt(slim)
        .groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("order", *[F.col(f"row.{k}") for k in keys], F.xxhash64("row"))
    return (
        dealt(rows)
        .withColumn("at", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select("row.*", "shard", (F.col("offset") + F.col("at") - 1).cast("bigint").alias("slot"))
    )

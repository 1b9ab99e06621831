"""Feature engineering on shot rows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.court import inferred_three, radius
from ..functions.numeric import lenient_double, text_or
from ..schema import ZONE_CATEGORIES
from .lineage import written

# The model's numeric features.
NUMERIC_FEATURES = ["loc_x", "loc_y", "distance", "angle", "is_3"]
UNKNOWN = "Unknown"


def with_features(shots: DataFrame) -> DataFrame:
    """Add distance (tenths of a foot), angle (radians), is_3; fill missing zones."""
    x, y = lenient_double(shots, "loc_x"), lenient_double(shots, "loc_y")
    three = inferred_three(shots)
    zones = {c: text_or(shots, c, UNKNOWN) for c in ZONE_CATEGORIES}
    return shots.withColumns(
        {"loc_x": x, "loc_y": y, "distance": radius(x, y), "angle": F.atan2(y, x), "is_3": three, **zones}
    )


def with_made_minus_expected(scored: DataFrame) -> DataFrame:
    """Add flag minus probability; an unscored shot gives null."""
    return scored.withColumn("made_minus_expected", F.col("shot_made_flag") - F.col("p_make"))


def _numeric_or_zero(df: DataFrame) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES}


def target(df: DataFrame) -> Column:
    """Made flag as integer, missing as 0."""
    return F.coalesce(lenient_double(df, "shot_made_flag").cast("int"), F.lit(0))


def one_hot_levels(shots: DataFrame) -> list[str]:
    """Frozen feature columns: the numerics, then one column per zone level seen."""
    feats = with_features(shots)
    pairs = feats.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in ZONE_CATEGORIES])).alias("p")
    ).select("p.name", "p.level").distinct()
    found = [(r["name"], r["level"]) for r in pairs.collect()]
    ordered = sorted(found, key=lambda p: (ZONE_CATEGORIES.index(p[0]), p[1]))
    return NUMERIC_FEATURES + [f"{name}_{level}" for name, level in ordered]


def model_matrix(shots: DataFrame, feature_columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One column per frozen feature: numerics with 0 for null, 0/1 for a zone level.

    A level not among the frozen columns leaves all columns of its zone at 0.
    ``keep`` names columns to carry along; the target is added when present.
    """
    feats = with_features(shots)
    numeric = _numeric_or_zero(feats)
    cols = [F.col(c) for c in keep or []]
    for name in feature_columns:
        if name in numeric:
            cols.append(numeric[name].alias(name))
            continue
        zone = next(c for c in ZONE_CATEGORIES if name.startswith(c + "_"))
        cols.append((F.col(zone) == name[len(zone) + 1 :]).cast("int").alias(name))
    if "shot_made_flag" in shots.columns:
        cols.append(target(feats).alias("label"))
    return feats.select(*cols)


def feature_stages() -> Pipeline:
    """ML stages from feature columns to a sparse vector; unseen levels are all zero."""
    indexed = [f"{c}_index" for c in ZONE_CATEGORIES]
    encoded = [f"{c}_onehot" for c in ZONE_CATEGORIES]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=ZONE_CATEGORIES, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error"),
            VectorAssembler(inputCols=[*NUMERIC_FEATURES, *encoded], outputCol="features"),
        ]
    )


def model_frame(shots: DataFrame) -> DataFrame:
    """Rows ready for ``feature_stages``: features filled, label added."""
    feats = with_features(shots)
    out = feats.withColumns(_numeric_or_zero(feats))
    return out.withColumn("label", target(feats).cast("double")) if "shot_made_flag" in shots.columns else out


def split_group(shots: DataFrame) -> Column:
    """What must not be cut by a train/test split: the game, else the player."""
    player = F.coalesce(F.col("player_id").cast("string"), F.lit("-1"))
    if "game_id" not in shots.columns:
        return player
    return F.coalesce(F.col("game_id"), F.concat(player, F.lit("_missing_game")))


def with_split(shots: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add is_test, equal for all rows of a group, for exactly ceil(test_share * groups) groups.

    The test groups are those of least 32-bit hash of (group, seed), ties by
    the group key. The k-th least hash is found without a sort: the groups are
    written once, counted by the top 12 bits of their hash, then by the next 12
    bits within the bucket where the count reaches k, then by the last 8 bits;
    each pass is one grouped count of at most 4,096 rows. Groups sharing the
    boundary hash (a handful at most) come to the driver to be ordered by key.
    """
    import math

    group = split_group(shots)
    digest = F.md5(F.concat(group, F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    marked = shots.withColumn("_group", group).withColumn("_hash", number)
    groups = written(marked.select("_group", "_hash").distinct())
    n_groups = groups.count()
    k = math.ceil(test_share * n_groups)
    if k <= 0:
        return marked.drop("_group", "_hash").withColumn("is_test", F.lit(False))
    if k >= n_groups:
        return marked.drop("_group", "_hash").withColumn("is_test", F.lit(True))
    prefix, below = 0, 0
    for shift, width in ((20, 12), (8, 12), (0, 8)):
        known = F.shiftright(F.col("_hash"), shift + width)
        counts = (
            groups.where(known == F.lit(prefix)) if shift != 20 else groups
        ).groupBy(F.shiftright(F.col("_hash"), shift).bitwiseAND((1 << width) - 1).alias("b")).count()
        for row in sorted(counts.collect()):
            if below + row["count"] >= k:
                prefix = (prefix << width) | row["b"]
                break
            below += row["count"]
    # prefix is now the k-th least hash; `below` groups lie under it.
    tied = sorted(r["_group"] for r in groups.where(F.col("_hash") == prefix).select("_group").collect())
    chosen = tied[: k - below]
    test = (F.col("_hash") < prefix) | ((F.col("_hash") == prefix) & F.col("_group").isin(chosen))
    return marked.withColumn("is_test", test).drop("_group", "_hash")

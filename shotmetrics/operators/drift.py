"""Feature drift between a recent and a baseline set of shots, and profiles of one set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import DISTANCE_UNIT, exact_weighted_mean, round_half_away, without_nan
from .lineage import checkpointed
from .ranking import quantile_steps, quantiles_of_counts

# Monitored features and alert thresholds.
NUMERIC_DRIFT = ["loc_x", "loc_y", "shot_distance"]
CATEGORY_DRIFT = ["shot_zone_basic", "shot_type"]
PSI_OK = 0.10
PSI_WARN = 0.25
SHARE_FLOOR = 1e-6
PROFILE_PERCENTS = [10, 25, 50, 75, 90]
# squares of coordinates are larger, so they are summed in coarser units
SQUARE_UNIT = 1000


def drift_status(psi: Column) -> Column:
    return F.when(psi < PSI_OK, "ok").when(psi < PSI_WARN, "warn").otherwise("alert")


def _long(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """(feature, x, category) for every known value: one scan serves all features."""
    pairs = [
        F.struct(F.lit(f).alias("feature"), without_nan(F.col(f).cast("double")).alias("x"), F.lit(None).cast("string").alias("category"))
        for f in numbers
    ] + [
        F.struct(F.lit(f).alias("feature"), F.lit(None).cast("double").alias("x"), F.col(f).cast("string").alias("category"))
        for f in categories
    ]
    return df.select(F.inline(F.array(*pairs))).where(F.col("x").isNotNull() | F.col("category").isNotNull())


def _counts(recent: DataFrame, baseline: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """(feature, x, category, e, a): occurrences of each value in baseline and recent.

    Numbers without a value on one of the sides are left out. A category that
    is new or has vanished altogether stays, as that is drift.
    """
    both = _long(recent, numbers, categories).withColumn("late", F.lit(1)).unionByName(
        _long(baseline, numbers, categories).withColumn("late", F.lit(0))
    )
    counted = both.groupBy("feature", "x", "category").agg(
        F.sum(1 - F.col("late")).alias("e"), F.sum("late").alias("a")
    )
    counted = checkpointed(counted)
    sides = counted.groupBy("feature").agg(F.sum("e").alias("_e"), F.sum("a").alias("_a"))
    # one row per feature
    usable = sides.where(F.col("feature").isin(categories) | (F.col("_e") > 0) & (F.col("_a") > 0)).select("feature")
    return counted.join(F.broadcast(usable), "feature", "left_semi")


def _shared(names: list[str], *frames: DataFrame) -> list[str]:
    return [n for n in names if all(n in f.columns for f in frames)]


def _psi(buckets: DataFrame, features: list[str]) -> DataFrame:
    """PSI per feature from (feature, bucket, e, a) counts.

    A feature without counts scores 0; a bucket missing on one side enters
    with the share floor.
    """
    totals = buckets.groupBy(F.col("feature").alias("_f")).agg(F.sum("e").alias("_e"), F.sum("a").alias("_a"))
    # one row per feature
    whole = buckets.join(F.broadcast(totals), F.col("feature") == F.col("_f"))

    def share(side: str) -> Column:
        part = F.try_divide(F.col(side).cast("double"), F.col(f"_{side}").cast("double"))
        return F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(SHARE_FLOOR))

    shares = whole.select("feature", share("e").alias("e"), share("a").alias("a"))
    term = (F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))
    scored = shares.groupBy("feature").agg(round_half_away(F.sum(term), 6).alias("psi"))
    names = buckets.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    psi = F.coalesce(F.col("psi"), F.lit(0.0))
    return names.join(scored, "feature", "left").select("feature", psi.alias("psi"), drift_status(psi).alias("status"))


def _numeric_buckets(counts: DataFrame, bins: int) -> DataFrame:
    """Counts per bin, the bins cut at the baseline's quantiles.

    Values outside the baseline's range count in no bin, so shares are taken
    of the values inside.
    """
    numbers = counts.where(F.col("x").isNotNull())
    edges = quantiles_of_counts(numbers, "x", "e", quantile_steps(bins), by=["feature"]).select("feature", "quantiles")
    # one row per feature
    rows = numbers.join(F.broadcast(edges), "feature")
    q, x = F.col("quantiles"), F.col("x")
    rows = rows.where((x >= q[0] - F.lit(1e-6)) & (x <= q[bins] + F.lit(1e-6)))
    number = F.lit(0)
    for i in range(1, bins):
        number = number + (x >= q[i]).cast("int")
    return rows.groupBy("feature", number.cast("string").alias("bucket")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))


def _category_buckets(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("category").isNotNull()).select("feature", F.col("category").alias("bucket"), "e", "a")


def psi_numeric(
    recent: DataFrame, baseline: DataFrame, features: list[str] | None = None, bins: int = 10
) -> DataFrame:
    """(feature, psi, status) of numeric features, over baseline-quantile bins."""
    features = _shared(features or NUMERIC_DRIFT, recent, baseline)
    return _psi(_numeric_buckets(_counts(recent, baseline, features, []), bins), features)


def psi_categorical(recent: DataFrame, baseline: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, psi, status) of categories, over those seen on either side."""
    features = _shared(features or CATEGORY_DRIFT, recent, baseline)
    return _psi(_category_buckets(_counts(recent, baseline, [], features)), features)


def drift_report(recent: DataFrame, baseline: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, psi, status) of all monitored features, scanning each side once."""
    numbers, categories = _shared(NUMERIC_DRIFT, recent, baseline), _shared(CATEGORY_DRIFT, recent, baseline)
    counts = _counts(recent, baseline, numbers, categories)
    buckets = _numeric_buckets(counts, bins).unionByName(_category_buckets(counts))
    return _psi(buckets, [*numbers, *categories])


def drift_map(report: DataFrame) -> DataFrame:
    """One row: the report as a map feature -> (psi, status)."""
    entry = F.struct("feature", F.struct("psi", "status").alias("info"))
    # five features at most
    return report.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("drift_report"))


def drift_rows(reports: DataFrame, column: str = "drift_report") -> DataFrame:
    """A report's map back to rows, keeping the report's other columns."""
    rest = [c for c in reports.columns if c != column]
    return reports.select(*rest, F.explode(column).alias("feature", "_info")).select(
        *rest, "feature", F.col("_info.psi").alias("psi"), F.col("_info.status").alias("status")
    )


def category_shares(df: DataFrame, features: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Share of each category among the feature's non-null values."""
    long = _long(df, [], features or CATEGORY_DRIFT)
    counts = checkpointed(long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(F.col("feature").alias("_f")).agg(F.sum("n").cast("double").alias("_all"))
    # one row per feature
    whole = counts.join(F.broadcast(totals), F.col("feature") == F.col("_f"))
    share = round_half_away(F.col("n").cast("double") / F.col("_all"), digits)
    return whole.select("feature", "category", "n", share.alias("share"))


def feature_profile(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Mean, population SD and five percentiles per numeric feature, from counted values."""
    long = _long(df, features or NUMERIC_DRIFT, [])
    counted = checkpointed(long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")))
    x, n = F.col("x"), F.col("n")
    moments = counted.groupBy("feature").agg(
        exact_weighted_mean(x, n, DISTANCE_UNIT).alias("mean"), exact_weighted_mean(x * x, n, SQUARE_UNIT).alias("_m2")
    )
    quantiles = quantiles_of_counts(counted, "x", "n", [p / 100 for p in PROFILE_PERCENTS], by=["feature"])
    return moments.join(quantiles, "feature").select(
        "feature",
        "mean",
        F.sqrt(F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"),
        *[F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate(PROFILE_PERCENTS)],
    )


def largest_season(shots: DataFrame) -> DataFrame:
    """The season and type with the most shots; the earlier name wins a tie."""
    counts = shots.groupBy("season", "season_type").agg(F.count(F.lit(1)).alias("n_shots"))
    return counts.orderBy(F.col("n_shots").desc(), "season", "season_type").limit(1)


def recent_window(
    scored: DataFrame,
    days: int | None = 30,
    season: str | None = None,
    season_type: str | None = None,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Rows of the last days before the newest game in scope (all dated rows if days is 0).

    The newest game is looked up in ``dates`` when given, such as the
    prediction table, which spares joining it for that.
    """

    def scope(df: DataFrame) -> DataFrame:
        if season is not None:
            df = df.where(F.col("season") == season)
            if season_type is not None:
                df = df.where(F.col("season_type") == season_type)
        return df

    if not days:
        return scope(scored).where(F.col("game_date").isNotNull())
    source = scored if dates is None else dates
    newest = scope(source).select(F.date_sub(F.max("game_date"), days).alias("d")).scalar()
    return scope(scored).where(F.col("game_date") >= newest)

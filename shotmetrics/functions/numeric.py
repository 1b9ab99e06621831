"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Averages are summed in fixed point so that a result does not depend on how
# rows were partitioned or in which order partial sums arrived (a retried task
# included). 1e-9 is finer than the single-precision scores of a tree model.
PROBABILITY_UNIT = 1_000_000_000
# Distances are feet or tenths of feet, up to some hundreds.
DISTANCE_UNIT = 1_000_000
# Units are summed as two longs of this radix; neither can overflow below
# about 1e14 rows per group.
_RADIX_BITS = 15
_RADIX = 1 << _RADIX_BITS


def lenient_double(df: DataFrame, name: str) -> Column:
    """Column as double; text that is no number, NaN or an absent column gives null."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("double")
    c = F.col(name)
    if kind == "string":
        # the cast accepts Java literals such as "5d"; those are not numbers here
        ends_so = F.substring(F.rtrim(c), -1, 1).isin("d", "D", "f", "F")
        java_literal = ends_so & F.trim(c).rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?[dDfF]$")
        c = F.when(~java_literal, c).try_cast("double")
        return without_nan(c)
    c = c.try_cast("double")
    return without_nan(c) if kind in ("double", "float") else c


def without_nan(c: Column) -> Column:
    """NaN as null, evaluating the column once."""
    return F.nanvl(c, F.lit(None).cast("double"))


def text_or(df: DataFrame, name: str, default: str = "") -> Column:
    """Column as text, with the default for null or an absent column."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def null_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            without_nan(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (greatest and least skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def round_half_away(c: Column, digits: int) -> Column:
    """Decimal rounding in plain double arithmetic, halves away from zero."""
    power = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(power) + F.lit(0.5)) / F.lit(power)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns, each to its own number of digits."""
    return df.withColumns({c: round_half_away(F.col(c), d) for c, d in digits.items()})


def _units(c: Column, unit: int) -> Column:
    return F.rint(c * F.lit(float(unit))).try_cast("bigint")


def _known(c: Column) -> Column:
    """Whether a value takes part in sums and means: neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _sums(c: Column, weight: Column | None, unit: int) -> tuple[Column, Column]:
    """Sum of the values that fit a long in units of 1/unit, in these units, and plain sum of the others.

    Values too large for a long, infinity included, are added as doubles: none
    is left out, only their last digits may depend on the order. Either sum is
    null without such values.
    """
    u = _units(c, unit)
    high, low = F.shiftright(u, _RADIX_BITS), u.bitwiseAND(F.lit(_RADIX - 1))
    large = F.when(u.isNull() & _known(c), c.cast("double"))
    if weight is not None:
        high, low, large = high * weight, low * weight, large * weight
    return F.sum(high).cast("double") * F.lit(float(_RADIX)) + F.sum(low).cast("double"), F.sum(large)


def _together(fixed: Column, large: Column) -> Column:
    return F.when(large.isNull(), fixed).when(fixed.isNull(), large).otherwise(fixed + large)


def exact_sum(c: Column, unit: int = PROBABILITY_UNIT) -> Column:
    """Aggregate: order-independent sum, in multiples of 1/unit (a double)."""
    fixed, large = _sums(c, None, unit)
    return _together(fixed, large * F.lit(float(unit)))


def exact_weighted_sum(c: Column, weight: Column, unit: int = PROBABILITY_UNIT) -> Column:
    """Aggregate: order-independent sum of value times a whole-number weight."""
    fixed, large = _sums(c, weight, unit)
    return _together(fixed / F.lit(float(unit)), large)


def exact_weighted_mean(c: Column, weight: Column, unit: int = PROBABILITY_UNIT) -> Column:
    """Aggregate: mean of counted values; null and NaN ones have no weight."""
    heft = F.sum(F.when(_known(c), weight)).cast("double")
    fixed, large = _sums(c, weight, unit)
    return _together(F.try_divide(fixed, heft * F.lit(float(unit))), F.try_divide(large, heft))


def exact_mean(c: Column, unit: int = PROBABILITY_UNIT) -> Column:
    """Aggregate: order-independent mean of the non-null values."""
    n = F.count(F.when(_known(c), 1)).cast("double")
    fixed, large = _sums(c, None, unit)
    return _together(F.try_divide(fixed, n * F.lit(float(unit))), F.try_divide(large, n))


def mean_flag(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds (unknown counts as not)."""
    hits = F.sum(F.when(condition, 1).otherwise(0)).cast("double")
    return F.try_divide(hits, F.count(F.lit(1)).cast("double"))


def mean_int(c: Column) -> Column:
    """Aggregate: mean of an integer column, summed as long."""
    return F.try_divide(F.sum(c.cast("bigint")).cast("double"), F.count(c).cast("double"))


def count_at_most(c: Column, edges: list[float]) -> Column:
    """How many of the given edges are <= the value: a bin number without a join."""
    total = F.lit(0)
    for e in edges:
        total = total + (c >= F.lit(float(e))).cast("int")
    return total


# Abramowitz and Stegun, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, 1 - erf(|z|/sqrt 2), to about 1.5e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + F.lit(a)) * t
    return series * F.exp(-x * x)

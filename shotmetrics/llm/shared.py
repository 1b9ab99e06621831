"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the words of a text, as the result contracts state them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def parallel_parts(spark: SparkSession) -> int:
    """How many tasks the session's shuffles run in."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use() mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, as array<struct<start, end, value>>.

    Offsets count code points from 0, the end is exclusive. The text between
    the matches comes from a split on the same pattern, so the offsets are
    running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def place(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        end = start + F.length(step["value"])
        match = F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(match)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.aggregate(F.filter(steps, lambda s: s["value"].isNotNull()), start, place, lambda done: done["out"])

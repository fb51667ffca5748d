"""Windows over a whole table, without one task for all of it.

Rows are cut into ranges of the value at approximate quantiles; windows run inside a range, and what a range needs of the
others comes from a table with one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64


def bounds_of(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    found = df.select(F.percentile_approx(F.col(value).cast("double"), [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(found or []))


def range_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are below the value: equal values are in one range, nulls in the first."""
    own = F.lit(0)
    for k, x in enumerate(bounds):
        own = F.when(value > F.lit(x), F.lit(k + 1)).otherwise(own)
    return own


def running_before(df: DataFrame, value: str, count: str, ranges: int = RANGES) -> DataFrame:
    """df (different values with counts) and `before`: the counts of all smaller values."""
    own = df.withColumn("__range", range_of(F.col(value), bounds_of(df, value, ranges)))
    totals = own.groupBy("__range").agg(F.sum(count).alias("__n"))
    earlier = totals.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    inside = F.sum(count).over(Window.partitionBy("__range").orderBy(value)) - F.col(count)
    return own.join(F.broadcast(earlier), "__range").withColumn("before", inside + F.col("__before")).drop("__range", "__before")


def average_ranks(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """(value, rank) of the different values of a column: ranks from 1, ties sharing their mean rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__k"))
    return running_before(counts, value, "__k", ranges).select(value, (F.col("before") + (F.col("__k") + 1) / 2).alias("rank"))


def around(points: DataFrame, at: DataFrame, value: str, keep: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(value, left, right) of the different values in `at`: structs of the columns of the last point not above it and of the first one above it, null where there is none."""
    row = F.struct(value, *keep)
    own = points.select(value, row.alias("point")).unionByName(at.select(value).filter(F.col(value).isNotNull()).distinct(), allowMissingColumns=True)
    own = own.withColumn("__range", range_of(F.col(value), bounds_of(own, value, ranges)))
    ends = own.groupBy("__range").agg(F.max_by("point", F.when(F.col("point").isNotNull(), F.col(value))).alias("last"), F.min_by("point", F.when(F.col("point").isNotNull(), F.col(value))).alias("first"))
    before, after = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("__range", F.last("last", ignorenulls=True).over(before).alias("__last"), F.first("first", ignorenulls=True).over(after).alias("__first"))  # a row for each range
    inside = Window.partitionBy("__range").orderBy(value, F.col("point").isNull())
    left, right = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    found = own.select("*", F.last("point", ignorenulls=True).over(left).alias("left"), F.first("point", ignorenulls=True).over(right).alias("right")).filter("point is null").join(F.broadcast(ends), "__range")
    return found.select(value, F.coalesce("left", "__last").alias("left"), F.coalesce("right", "__first").alias("right"))

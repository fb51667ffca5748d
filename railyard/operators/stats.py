"""Distribution statistics over groups, each as aggregates and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.operators import order


def gini(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """0 if the sum is 0."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, F.col(value).alias("x"), F.row_number().over(w.orderBy(value, tie)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    top = F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("x"))
    return ranked.groupBy(*keys).agg(F.when(F.sum("x") == 0, 0.0).otherwise(F.try_divide(top, F.max("n") * F.sum("x"))).alias("gini"))


def top_share(df: DataFrame, keys: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    """Share of the k largest in the total of each group."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)))
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("__r") <= k, F.col(value))), F.sum(value)).alias("share"))


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Ranks from 1 in each group, ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    if not keys:  # the whole table is no window
        both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        ranks = lambda c, name: order.average_ranks(both, c).withColumnRenamed("rank", name)
        return both.select(x, y).join(ranks(x, "rx"), x).join(ranks(y, "ry"), y).agg(F.corr("rx", "ry").alias("rho"))
    ranked = df.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"))


def min_max(value: str, keys: Sequence[str], floor: float = 1e-300) -> Column:
    """Scaled to 0..1 in each group."""
    w = Window.partitionBy(*keys)
    return (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + floor)


def criticality(df: DataFrame, keys: Sequence[str], importance: str, vulnerability: str) -> DataFrame:
    """Geometric mean of scaled importance and vulnerability."""
    return df.withColumn("criticality", F.sqrt(min_max(importance, keys) * min_max(vulnerability, keys)))


def expected_shortfall(od: DataFrame, keys: Sequence[str], value: str, weight: str, ties: Sequence[str], tail: float = 0.1) -> DataFrame:
    """Weighted mean of the worst `tail` of the mass; the row at the boundary counts in part."""
    w = Window.partitionBy(*keys)
    upto = F.sum(weight).over(w.orderBy(F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, 0))
    ranked = od.select(*keys, F.col(value).alias("v"), F.col(weight).alias("w"), (upto - F.col(weight)).alias("before"), (F.sum(weight).over(w) * tail).alias("mass"))
    part = F.greatest(F.lit(0.0), F.least(F.col("w"), F.col("mass") - F.col("before")))
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(part * F.col("v")), F.sum(part)).alias("shortfall"))


def accessibility(od: DataFrame, origin: str = "o", time: str = "t", weight: str = "w") -> DataFrame:
    """Mean of 1 / time over the weights of each origin; pairs without time add weight only; 0 without weight."""
    return od.groupBy(origin).agg(F.coalesce(F.try_divide(F.sum(F.coalesce(F.try_divide(F.col(weight), F.col(time)), F.lit(0.0))), F.sum(weight)), F.lit(0.0)).alias("access"))


def shares(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of each group and its share of all groups. The second sum is over the grouped rows only."""
    own = df.groupBy(*keys).agg(F.sum(value).alias(value))
    total = own.agg(F.sum(value).alias("__all"))
    return own.crossJoin(F.broadcast(total)).select(*keys, value, F.try_divide(F.col(value), F.col("__all")).alias(name))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], ranges: int = order.RANGES) -> DataFrame:
    """(keys, a column for each share): exact quantiles, straight between neighbours, as percentile() gives them, for few and large groups.

    Values are counted, and the counts summed up inside ranges of the value, so no task holds the values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    own = counts.withColumn("__range", order.range_of(F.col("__v"), order.bounds_of(df, value, ranges)))
    w = Window.partitionBy(*keys)
    totals = own.groupBy(*keys, "__range").agg(F.sum("__k").alias("__n"))  # a row for each group and range
    totals = totals.select(*keys, "__range", (F.sum("__n").over(w.orderBy("__range")) - F.col("__n")).alias("__earlier"), F.sum("__n").over(w).alias("__all"))
    totals = totals.withColumnsRenamed({c: f"__of_{c}" for c in (*keys, "__range")})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, "__range")]
    upto = F.sum("__k").over(Window.partitionBy(*keys, "__range").orderBy("__v"))
    placed = own.join(totals, same).withColumn("__end", F.col("__earlier") + upto).withColumn("__begin", F.col("__end") - F.col("__k"))
    found, out = [], []
    for k, (name, q) in enumerate(shares.items()):
        at = F.lit(float(q)) * (F.col("__all") - 1)
        here = lambda p: F.max(F.when((F.col("__begin") <= p) & (F.col("__end") > p), F.col("__v")))
        found += [here(F.floor(at)).alias(f"__low{k}"), here(F.ceil(at)).alias(f"__high{k}"), F.max(at - F.floor(at)).alias(f"__part{k}")]
        out.append(((1 - F.col(f"__part{k}")) * F.col(f"__low{k}") + F.col(f"__part{k}") * F.col(f"__high{k}")).alias(name))
    return placed.groupBy(*keys).agg(*found).select(*keys, *out)


def largest_remainder(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Whole numbers that add up to the rounded (half to even) total of each group. Decimals are exact, so equal remainders tie."""
    w = Window.partitionBy(*keys)
    floor = F.floor(value)
    left = F.bround(F.sum(value).over(w), 0) - F.sum(floor).over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.col(value) - floor), tie))
    return df.withColumn("whole", (floor + F.when(rank <= left, 1).otherwise(0)).cast("long"))

"""From visits (mode, trip, stop, seq, arr_s, dep_s, dist) to stop pairs, edges, rates and segments.

One window over trips serves all modes at once: mode is a grouping key, not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.functions.scalar import clipped


def trip_order(order: Sequence[str], trip: str = "trip"):
    return Window.partitionBy(trip).orderBy(*order)


def consecutive(visits: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Rows (mode, trip, i, j, tau_s, dist_m, dep_s) of stops that follow one another in a trip.

    The next visit is looked up before any filter by time: a pair whose second half is outside a window still counts.
    """
    w = trip_order(order)
    nxt = visits.select("mode", "trip", F.col("stop").alias("i"), "dep_s", *[c for c in order if c != "dep_s"], F.lead("stop").over(w).alias("j"), F.lead("arr_s").over(w).alias("arr_j"), (F.lead("dist").over(w) - F.col("dist")).alias("step"))
    return nxt.filter(F.col("j").isNotNull()).select("mode", "trip", "i", "j", clipped(F.col("arr_j") - F.col("dep_s"), 0.0).alias("tau_s"), clipped("step", 0.0).alias("dist_m"), "dep_s")


def edge_stats(pairs: DataFrame) -> DataFrame:
    """Median time and distance of each (mode, i, j), without loops."""
    return pairs.filter("i <> j").groupBy("mode", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.median("tau_s").alias("tau_s"), F.median("dist_m").alias("dist_m"))


def in_window(dep: str, start: float, end: float) -> Column:
    """Half open."""
    return (F.col(dep) >= start) & (F.col(dep) < end)


def departure_rates(visits: DataFrame, seconds: float) -> DataFrame:
    """mu: distinct trips that leave a stop, for each second of the window."""
    return visits.groupBy("mode", "stop").agg(F.countDistinct("trip").alias("trips")).withColumn("mu", F.col("trips") / F.lit(float(seconds)))


def least_transfer(transfers: DataFrame, default: float = 120.0) -> DataFrame:
    """Smallest transfer time from each stop; a missing time counts as the default."""
    return transfers.groupBy("from_stop").agg(F.min(F.coalesce(F.col("min_transfer_time").try_cast("double"), F.lit(default))).alias("transfer_s"))


def headway_irregularity(departures: DataFrame, keys: Sequence[str], dep: str = "dep_s") -> DataFrame:
    """CV^2 of headways of each group; 1 with fewer than 3 departures or a mean of 0."""
    gaps = departures.select(*keys, (F.col(dep) - F.lag(dep).over(Window.partitionBy(*keys).orderBy(dep))).alias("gap"))
    own = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("var_gap"))
    return own.select(*keys, "n", "mean_gap", _cv2().alias("cv2"))


def _cv2() -> Column:
    return F.when((F.col("n") < 3) | (F.col("mean_gap") == 0), F.lit(1.0)).otherwise(F.col("var_gap") / (F.col("mean_gap") * F.col("mean_gap")))


def segment_figures(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mode, n, tau_s, cv2): smallest mode, departures, median of tau and irregularity of dep_s of each group, all in one shuffle.

    The median is what stands in the middle of the group's rows by tau: where most groups have few rows, as stop pairs do,
    that is cheaper than a table of values for each.
    """
    group = Window.partitionBy(*keys)
    gaps = pairs.select(*keys, "mode", "tau", (F.col("dep_s") - F.lag("dep_s").over(group.orderBy("dep_s"))).alias("gap"))
    ranked = gaps.select("*", F.row_number().over(group.orderBy(F.asc_nulls_last("tau"))).alias("rank"), F.count("tau").over(group).alias("known"))
    middle = F.when(F.expr("rank in ((known + 1) div 2, known div 2 + 1)"), F.col("tau"))
    own = ranked.groupBy(*keys).agg(F.min("mode").alias("mode"), F.count(F.lit(1)).alias("n"), ((F.min(middle) + F.max(middle)) / 2).alias("tau_s"), F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("var_gap"))
    return own.select(*keys, "mode", "n", "tau_s", _cv2().alias("cv2"))


def segment_stats(pairs: DataFrame, window_s: float, least_tau: float = 20.0) -> DataFrame:
    """Frequency and running time of each (route, i, j); pairs has mode too, and the smallest mode stands for the segment."""
    return pairs.groupBy("route", "i", "j").agg(F.min("mode").alias("mode"), F.count(F.lit(1)).alias("n"), F.greatest(F.median("tau_s"), F.lit(least_tau)).alias("tau_s")).withColumn("freq", F.col("n") / F.lit(float(window_s)))


def continuation(visits: DataFrame, order: Sequence[str] = ("seq",), route: str = "mode") -> DataFrame:
    """Shares (route, i, j, k, share) of departures on segment i-j that go on to k, and the share that ends there (k null)."""
    w = trip_order(order)
    chain = visits.select(F.col(route).alias("route"), F.col("stop").alias("i"), F.lead("stop").over(w).alias("j"), F.lead("stop", 2).over(w).alias("k")).filter("j is not null")
    counts = chain.groupBy("route", "i", "j", "k").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("route", "i", "j")))


def undirected(flows: DataFrame) -> DataFrame:
    """Flows (i, j, flow) summed over both directions."""
    return flows.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("flow").alias("flow"))


def summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, fill and mean degree of each mode."""
    ends = edges.select("mode", F.explode(F.array("i", "j")).alias("node"))
    nodes = ends.groupBy("mode").agg(F.countDistinct("node").alias("nodes"))
    return edges.groupBy("mode").agg(F.count(F.lit(1)).alias("edges")).join(nodes, "mode").select("mode", "nodes", "edges", F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("fill"), (F.col("edges") / F.col("nodes")).alias("degree"))


def supply_share(visits: DataFrame, start: float, end: float, dep: str = "dep_s") -> DataFrame:
    """Share of departures in a time of day, clock times beyond midnight folded back."""
    clock = F.col(dep) % 86400
    return visits.groupBy("mode").agg(F.avg(F.when((clock >= start) & (clock < end), 1.0).otherwise(0.0)).alias("share"))

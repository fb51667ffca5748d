"""Stop-to-stop networks of all modes from a feed: edges with generalised costs, and departure rates.

One pipeline for all modes: the mode is a grouping key. Travel times come from all trips, rates from the window only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.fixpoint import cut
from railyard.functions import scalar
from railyard.operators import edges, graph
from railyard.plans import chain as markov
from railyard.plans.linenet import kappa_of
from railyard.sources.feed import Feed


@dataclass(frozen=True)
class ModalNetwork:
    """edges (mode, i, j, tau_s, dist_m, transfer_s, cost); nodes (mode, stop, mu)."""

    edges: DataFrame
    nodes: DataFrame

    def summary(self) -> DataFrame:
        top = self.nodes.groupBy("mode").agg(F.max("mu").alias("largest_mu"))
        return edges.summary(self.edges).join(top, "mode", "left")

    def rates(self) -> DataFrame:
        return self.nodes.select("mode", F.col("stop").alias("i"), "mu")

    def chain(self, lam: float = markov.LAMBDA) -> DataFrame:
        return markov.kernel(self.edges, lam)

    def generator(self, lam: float = markov.LAMBDA) -> DataFrame:
        return markov.generator(self.chain(lam), self.rates())


def build(feed: Feed, window: tuple[float, float] = (25200.0, 32400.0), kappa: dict | None = None, gamma: float = 0.01, delta: float = 1.0, modes: list[int] | None = None) -> ModalNetwork:
    """ValueError if an edge has neither distances nor coordinates."""
    start, end = window
    routes = feed["routes"].select("route_id", F.col("route_type").try_cast("int").alias("mode")).filter("mode is not null")
    if modes is not None:
        routes = routes.filter(F.col("mode").isin(modes))
    times = feed["stop_times"]
    dist = F.col("shape_dist_traveled").try_cast("double") if "shape_dist_traveled" in times.columns else F.lit(None).cast("double")
    visits = times.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), scalar.seconds_of("arrival_time").alias("arr_s"), scalar.seconds_of("departure_time").alias("dep_s"), dist.alias("dist"))
    visits = visits.dropna(subset=["dep_s"]).join(feed["trips"].select("trip_id", "route_id"), "trip_id").join(routes, "route_id")
    parent = F.col("parent_station") if "parent_station" in feed["stops"].columns else F.lit(None).cast("string")
    stops = feed["stops"].select("stop_id", scalar.parent_or_self("stop_id", parent).alias("station"), F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"))
    visits = visits.join(stops.select("stop_id", "station"), "stop_id", "left").select("mode", "trip_id", "seq", "arr_s", "dep_s", "dist", F.coalesce("station", "stop_id").alias("station"))
    visits = cut(visits)  # for edges and for rates

    w = Window.partitionBy("trip_id").orderBy("seq")
    nxt = visits.select("mode", F.col("station").alias("i"), F.lead("station").over(w).alias("j"), "dep_s", F.lead("arr_s").over(w).alias("arr_j"), "seq", F.lead("seq").over(w).alias("seq_j"), (F.lead("dist").over(w) - F.col("dist")).alias("step"))
    pairs = nxt.filter("j is not null and seq < seq_j and i <> j").select("mode", "i", "j", scalar.clipped(F.col("arr_j") - F.col("dep_s"), 0.0).alias("tau_s"), scalar.clipped("step", 0.0).alias("dist_m"))
    own = edges.edge_stats(pairs)
    at = lambda c: stops.select(F.col("stop_id").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    own = own.join(at("i"), "i", "left").join(at("j"), "j", "left").withColumn("dist_m", F.coalesce("dist_m", scalar.haversine_m("lat_i", "lon_i", "lat_j", "lon_j")))
    if "transfers" in feed:
        least = edges.least_transfer(feed["transfers"].withColumnRenamed("from_stop_id", "from_stop")).select(F.col("from_stop").alias("i"), "transfer_s")
        own = own.join(least, "i", "left")
    else:
        own = own.withColumn("transfer_s", F.lit(None).cast("double"))
    own = own.withColumn("transfer_s", F.coalesce("transfer_s", F.lit(0.0)))
    cost = scalar.generalised_cost(kappa_of("mode", kappa or {}), "tau_s", gamma, "dist_m", delta, "transfer_s")
    own = cut(own.select("mode", "i", "j", "n", "tau_s", "dist_m", "transfer_s", cost.alias("cost")))
    if lost := own.filter("dist_m is null").head(5):
        raise ValueError(f"no distance for {[(r['i'], r['j']) for r in lost]}")
    peak = visits.filter(edges.in_window("dep_s", start, end)).select("mode", F.col("station").alias("stop"), F.col("trip_id").alias("trip"))
    nodes = own.select("mode", F.explode(F.array("i", "j")).alias("stop")).distinct().join(edges.departure_rates(peak, end - start), ["mode", "stop"], "left")
    return ModalNetwork(own, cut(nodes.select("mode", "stop", F.coalesce("mu", F.lit(0.0)).alias("mu"))))


def resilience(net: ModalNetwork, top: int = 100, lam: float = markov.LAMBDA, n_rounds: int = 200) -> DataFrame:
    """Scores of each mode's `top` stops by departure flux: importance, the three drops, vulnerability, criticality."""
    from railyard.operators import stats

    own = cut(net.chain(lam))
    flux = markov.departure_flux(markov.stationary(own, n_rounds=n_rounds), net.rates())
    rank = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("flux"), "node"))
    picked = cut(flux.withColumn("r", rank).filter(F.col("r") <= top).select("mode", "node", F.col("flux").alias("importance")))
    scored = markov.removals(own, picked).join(picked, ["mode", "node"])
    return stats.criticality(scored, ["mode"], "importance", "vulnerability")


def connected(net: ModalNetwork) -> bool:
    return graph.irreducible(net.edges)

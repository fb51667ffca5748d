"""The driver's tables as the library's: visits of trips to stops, services, coordinates. And the same in SQL.

events: a user is a trip, an event type a stop, time in hours. lineitem: an order is a trip, its priority the mode, the
supplier's nation the stop (the supplier is a platform of it), time in days, quantity the running distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from railyard.fixpoint import cut
from railyard.operators import edges
from railyard.registry import table

EVENT_ORDER = ("dep_s", "event_id")
LINE_ORDER = ("dep_s", "l_linenumber", "l_partkey", "l_suppkey")
#: Weight of time by mode, as literals of the adapter.
KAPPA = {"1-URGENT": 0.4, "2-HIGH": 0.7, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 1.2, "5-LOW": 0.55}


def hours(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) / 3600000000D")


def days(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) / 86400000000D")


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit("all").alias("mode"), F.col("user_id").alias("trip"), F.col("event_type").alias("stop"), hours("ts").alias("dep_s"), hours("ts").alias("arr_s"), F.col("value").alias("dist"), "event_id")


def line_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", days("l_shipdate").alias("dep_s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    stops = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(stops, lines.l_suppkey == stops.s_suppkey)
    return joined.select(F.col("o_orderpriority").alias("mode"), F.col("l_orderkey").alias("trip"), F.col("s_nationkey").alias("stop"), "dep_s", F.col("dep_s").alias("arr_s"), F.col("l_quantity").alias("dist"), "l_linenumber", "l_partkey", "l_suppkey")


def event_pairs(spark, sf_dir) -> DataFrame:
    return edges.consecutive(event_visits(spark, sf_dir), EVENT_ORDER)


def line_pairs(spark, sf_dir) -> DataFrame:
    return edges.consecutive(line_visits(spark, sf_dir), LINE_ORDER)


def event_edges(spark, sf_dir) -> DataFrame:
    return edges.edge_stats(event_pairs(spark, sf_dir))


def line_edges(spark, sf_dir) -> DataFrame:
    return edges.edge_stats(line_pairs(spark, sf_dir))


def kappa(mode="mode"):
    out = F.lit(1.0)
    for name, k in KAPPA.items():
        out = F.when(F.col(mode) == name, F.lit(k)).otherwise(out)
    return out


def hub_costs(spark, sf_dir) -> DataFrame:
    """(i, j, cost): the cheapest mode between two nations, median days weighted by mode plus a tenth of the distance plus one."""
    return line_edges(spark, sf_dir).groupBy("i", "j").agg(F.min(kappa() * F.col("tau_s") + 0.1 * F.col("dist_m") + 1.0).alias("cost"))


def hub_graph(spark, sf_dir) -> DataFrame:
    """hub_costs(), made once for a query that uses it several times."""
    return cut(hub_costs(spark, sf_dir))


def regional_graph(spark, sf_dir) -> DataFrame:
    """The links of hub_costs() inside a region, and those between the first nations of two regions: a network that lacks links, for queries that look for new ones."""
    regions = table(spark, sf_dir, "nation").withColumn("first", F.min("n_nationkey").over(Window.partitionBy("n_regionkey")))
    at = lambda end: regions.select(F.col("n_nationkey").alias(end), F.col("n_regionkey").alias(f"region_{end}"), (F.col("n_nationkey") == F.col("first")).alias(f"first_{end}"))
    own = hub_costs(spark, sf_dir).join(at("i"), "i").join(at("j"), "j")
    return cut(own.filter("region_i = region_j or (first_i and first_j)").select("i", "j", "cost"))


def nation_points(spark, sf_dir) -> DataFrame:
    """(node, lat, lon): invented coordinates by formula."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region"), (F.lit(47.4) + F.col("n_nationkey") * 0.01).alias("lat"), (F.lit(19.0) + (F.col("n_nationkey") * 7 % 25) * 0.01).alias("lon"))


# The same in SQL
EV = "ev AS (SELECT 'all' AS mode, user_id AS trip, event_type AS stop, date_diff('microsecond', TIMESTAMP '1970-01-01', ts) / 3600000000.0 AS dep_s, value AS dist, event_id FROM events)"
EP = EV + ", ep0 AS (SELECT mode, trip, stop AS i, dep_s, dist, lead(stop) OVER w AS j, lead(dep_s) OVER w AS arr_j, lead(dist) OVER w AS dist_j FROM ev WINDOW w AS (PARTITION BY trip ORDER BY dep_s, event_id)), ep AS (SELECT mode, trip, i, j, greatest(arr_j - dep_s, 0) AS tau_s, greatest(dist_j - dist, 0) AS dist_m, dep_s FROM ep0 WHERE j IS NOT NULL)"
EE = EP + ", ee AS (SELECT mode, i, j, count(*) AS n, median(tau_s) AS tau_s, median(dist_m) AS dist_m FROM ep WHERE i <> j GROUP BY mode, i, j)"
LV = "lv AS (SELECT o_orderpriority AS mode, l_orderkey AS trip, s_nationkey AS stop, date_diff('microsecond', TIMESTAMP '1970-01-01', l_shipdate) / 86400000000.0 AS dep_s, l_quantity AS dist, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"
LP = LV + ", lp0 AS (SELECT mode, trip, stop AS i, dep_s, dist, lead(stop) OVER w AS j, lead(dep_s) OVER w AS arr_j, lead(dist) OVER w AS dist_j FROM lv WINDOW w AS (PARTITION BY trip ORDER BY dep_s, l_linenumber, l_partkey, l_suppkey)), lp AS (SELECT mode, trip, i, j, greatest(arr_j - dep_s, 0) AS tau_s, greatest(dist_j - dist, 0) AS dist_m, dep_s FROM lp0 WHERE j IS NOT NULL)"
LE = LP + ", le AS (SELECT mode, i, j, count(*) AS n, median(tau_s) AS tau_s, median(dist_m) AS dist_m FROM lp WHERE i <> j GROUP BY mode, i, j)"
KAPPA_SQL = "CASE mode " + " ".join(f"WHEN '{m}' THEN {k}" for m, k in KAPPA.items()) + " ELSE 1.0 END"
HC = LE + f", hc AS (SELECT i, j, min({KAPPA_SQL} * tau_s + 0.1 * dist_m + 1.0) AS cost FROM le GROUP BY i, j)"
SG = HC + ", sg AS MATERIALIZED (SELECT i, j, cost FROM hc)"
RG = HC + ", fr AS (SELECT n_nationkey AS k, n_regionkey AS r, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS f FROM nation), sg AS MATERIALIZED (SELECT i, j, cost FROM hc JOIN fr a ON a.k = i JOIN fr b ON b.k = j WHERE a.r = b.r OR (a.f AND b.f))"
NP = "np AS (SELECT n_nationkey AS node, n_regionkey AS region, 47.4::DOUBLE + n_nationkey * 0.01::DOUBLE AS lat, 19.0::DOUBLE + (n_nationkey * 7 % 25) * 0.01::DOUBLE AS lon FROM nation)"
HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2))))"


def haversine_sql(a: str, b: str) -> str:
    return HAVERSINE.format(lat1=f"{a}.lat::DOUBLE", lon1=f"{a}.lon::DOUBLE", lat2=f"{b}.lat::DOUBLE", lon2=f"{b}.lon::DOUBLE")

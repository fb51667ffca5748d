"""Queries: demand and spatial operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from railyard.fixpoint import cut
from railyard.functions import scalar
from railyard.operators import graph, order, spatial, stats
from railyard.plans import demand
from railyard.queries import tables as t
from railyard.queries.chains import SP
from railyard.registry import Registry, table

Q = Registry()
R = lambda c, n=6: F.round(c, n).alias(c)

MU = "mu AS (SELECT stop, count(DISTINCT trip) / 7200.0 AS mu FROM lv GROUP BY stop)"


def hub_rates(spark, sf_dir):
    return t.line_visits(spark, sf_dir).groupBy("stop").agg((F.countDistinct("trip") / 7200.0).alias("mu"))


@Q.add(f"WITH {t.LV}, {MU} SELECT stop, round(mu / sum(mu) OVER () * 800000.0, 4) AS n FROM mu")
def prior_e1(spark, sf_dir):
    return demand.service_prior(hub_rates(spark, sf_dir), demand.peak_riders()).select("stop", R("n", 4))


FT = f"{t.LV}, {MU}, ft AS (SELECT stop, mu AS service, coalesce(pop, 0.0) AS population, coalesce(poi, 0) AS attraction, (stop % 7) / 10.0 AS betweenness, CASE WHEN stop % 2 = 0 THEN 1.0 ELSE 0.0 END AS transfer, 1.0 * stop AS distance FROM mu LEFT JOIN (SELECT c_nationkey, greatest(sum(c_acctbal), 0.0) AS pop FROM customer GROUP BY c_nationkey) ON c_nationkey = stop LEFT JOIN (SELECT s_nationkey, count(*) AS poi FROM supplier GROUP BY s_nationkey) ON s_nationkey = stop)"


def hub_features(spark, sf_dir):
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("stop")).agg(F.greatest(F.sum("c_acctbal"), F.lit(0.0)).alias("population"))
    places = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("stop")).agg(F.count(F.lit(1)).alias("attraction"))
    own = hub_rates(spark, sf_dir).join(people, "stop", "left").join(places, "stop", "left")
    return own.select("stop", F.col("mu").alias("service"), F.coalesce("population", F.lit(0.0)).alias("population"), F.coalesce("attraction", F.lit(0)).alias("attraction"), ((F.col("stop") % 7) / 10.0).alias("betweenness"), F.when(F.col("stop") % 2 == 0, 1.0).otherwise(0.0).alias("transfer"), F.col("stop").cast("double").alias("distance"))


@Q.add(f"WITH {FT}, x AS (SELECT stop, 0.7 * ln(1 + 3600 * service) + 0.6 * ln(1 + population) + 0.2 * ln(1 + attraction) + 0.3 * betweenness + 0.5 * transfer - 0.25 * ln(1 + distance) AS x FROM ft), w AS (SELECT stop, exp(x - max(x) OVER ()) AS w FROM x) SELECT stop, round(w / sum(w) OVER () * 800000.0, 4) AS n FROM w")
def prior_e2(spark, sf_dir):
    return demand.log_linear(hub_features(spark, sf_dir), demand.peak_riders()).select("stop", R("n", 4))


DRAWN = [list(map(float, row)) for row in np.random.default_rng(42).normal(demand.BETA_MEAN, demand.BETA_SD, size=(100, len(demand.BETA_MEAN)))]


@Q.add(f"WITH {FT}, dr AS (SELECT unnest({DRAWN}::DOUBLE[][]) AS b), dn AS (SELECT row_number() OVER () AS draw, b FROM dr), x AS (SELECT draw, stop, b[1] * ln(1 + 3600 * service) + b[2] * ln(1 + population) + b[3] * ln(1 + attraction) + b[4] * betweenness + b[5] * transfer + b[6] * ln(1 + distance) AS x FROM ft, dn), w AS (SELECT draw, stop, exp(x - max(x) OVER (PARTITION BY draw)) AS w FROM x), n AS (SELECT stop, w / sum(w) OVER (PARTITION BY draw) * 800000.0 AS n FROM w) SELECT stop, round(avg(n), 3) AS mean, round(quantile_cont(n, 0.05), 3) AS q05, round(quantile_cont(n, 0.95), 3) AS q95 FROM n GROUP BY stop")
def prior_e3(spark, sf_dir):
    """Mean and 90 percent band of the prior under random coefficients, which the SQL has as numbers."""
    return demand.monte_carlo(hub_features(spark, sf_dir), demand.peak_riders(), draws=100).select("stop", R("mean", 3), R("q05", 3), R("q95", 3))


@Q.add("SELECT event_id, round((ARRAY" + str(list(scalar.DIURNAL)) + ")[(event_id % 48) % 24 + 1]::DOUBLE / 0.21, 9) AS scale FROM events")
def diurnal_scale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scalar.diurnal_scale(F.col("event_id") % 48 - 48), 9).alias("scale"))


CM = "cm AS (SELECT c_nationkey, avg(c_acctbal) AS cars FROM customer GROUP BY c_nationkey)"


@Q.add(f"WITH {CM} SELECT c_nationkey, round(CASE WHEN c_nationkey % 5 = 0 THEN 0.35 ELSE 1 / (1 + exp(-(ln(0.4 / 0.6) - 1.0 * (cars - avg(cars) OVER ()) / stddev_pop(cars) OVER ()))) END, 8) AS share FROM cm")
def propensity(spark, sf_dir):
    cars = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("cars")).withColumn("seen", F.when(F.col("c_nationkey") % 5 == 0, 0.35))
    return demand.propensity(cars, "cars", 0.4, 1.0, "seen").select("c_nationkey", R("share", 8))


@Q.add("WITH m AS (SELECT c_nationkey AS hub, list(DISTINCT CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 2 WHEN 'HOUSEHOLD' THEN 800 ELSE 11 END AS INTEGER)) AS ms FROM customer GROUP BY c_nationkey) SELECT hub, CASE WHEN list_contains(ms, 1) THEN 1 WHEN list_contains(ms, 109) THEN 109 WHEN list_contains(ms, 0) THEN 0 WHEN list_contains(ms, 11) THEN 11 WHEN list_contains(ms, 3) THEN 3 WHEN list_contains(ms, 4) THEN 4 ELSE -1 END AS cls FROM m")
def hub_class(spark, sf_dir):
    mode = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 2 WHEN 'HOUSEHOLD' THEN 800 ELSE 11 END")
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("hub")).agg(F.collect_set(mode).alias("ms"))
    return own.select("hub", demand.hub_class("ms").alias("cls"))


# customers as cells around their nation's place, suppliers as hubs; metres by formula
CELLS = "cells AS (SELECT c_custkey AS cell, (c_nationkey % 5) * 1000.0 + (c_custkey * 37 % 1000) AS lx, (c_nationkey // 5) * 1000.0 + (c_custkey * 91 % 1000) AS ly, greatest(c_acctbal, 0.0) AS people FROM customer), hubs AS (SELECT s_suppkey AS hub, (s_nationkey % 5) * 1000.0 + (s_suppkey * 53 % 1000) AS rx, (s_nationkey // 5) * 1000.0 + (s_suppkey * 17 % 1000) AS ry, s_suppkey % 3 AS class FROM supplier), near AS (SELECT cell, hub, class, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS dist, people FROM cells, hubs WHERE sqrt((lx - rx) ** 2 + (ly - ry) ** 2) <= 300), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, class ORDER BY dist, hub) AS rank FROM near) WHERE rank <= 3)"


def cells(spark, sf_dir):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("cell"), ((n % 5) * 1000.0 + (k * 37 % 1000)).alias("lx"), (F.floor(n / 5) * 1000.0 + (k * 91 % 1000)).alias("ly"), F.greatest("c_acctbal", F.lit(0.0)).alias("people"))


def hubs(spark, sf_dir):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("hub"), ((n % 5) * 1000.0 + (k * 53 % 1000)).alias("rx"), (F.floor(n / 5) * 1000.0 + (k * 17 % 1000)).alias("ry"), (k % 3).alias("class"))


def candidates(spark, sf_dir):
    return spatial.nearest_within(cells(spark, sf_dir), hubs(spark, sf_dir), 300.0, "cell", 3, "hub", ["people"], ["class"])


@Q.add(f"WITH {CELLS} SELECT cell, hub, class, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM knn")
def knn_radius(spark, sf_dir):
    return candidates(spark, sf_dir).select("cell", "hub", "class", "rank", R("dist"))


@Q.add(f"WITH {CELLS}, one AS (SELECT * FROM (SELECT cell, hub, dist, row_number() OVER (PARTITION BY cell ORDER BY dist, hub) AS r FROM near WHERE dist <= 120) WHERE r = 1) SELECT cell, hub, round(dist, 6) AS dist FROM cells LEFT JOIN one USING (cell)")
def nearest_snap(spark, sf_dir):
    return spatial.snap(cells(spark, sf_dir), hubs(spark, sf_dir), 120.0, "cell", "hub").select("cell", "hub", R("dist"))


@Q.add(f"WITH {CELLS}, w AS (SELECT *, CASE class WHEN 0 THEN 0.5 WHEN 1 THEN -0.2 ELSE 0.0 END - dist / 250.0 AS u FROM knn), e AS (SELECT *, exp(u - max(u) OVER (PARTITION BY cell)) AS w FROM w), p AS (SELECT hub, people * w / sum(w) OVER (PARTITION BY cell) AS p FROM e) SELECT hub, round(sum(p), 4) AS people FROM p GROUP BY hub")
def logit_access(spark, sf_dir):
    return demand.assign(candidates(spark, sf_dir), 250.0, {0: 0.5, 1: -0.2}).select("hub", R("people", 4))


@Q.add(f"WITH {CELLS} SELECT round(coalesce(sum(people), 0.0), 4) AS uncovered FROM cells WHERE cell NOT IN (SELECT cell FROM knn)")
def uncovered_people(spark, sf_dir):
    own = cells(spark, sf_dir)
    one = spatial.nearest_within(own, hubs(spark, sf_dir), 300.0, "cell", 1, "hub")  # of any class
    return demand.uncovered(own, one).select(R("uncovered", 4))


OD = SP + ", tt AS (SELECT source AS o, node AS d, t FROM sp WHERE source <> node), og AS (SELECT c_nationkey AS o, sum(greatest(c_acctbal, 0.0)) / 1000 AS made, min(n_regionkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey), ad AS (SELECT s_nationkey AS d, sum(greatest(s_acctbal, 0.0)) / 1000 AS drawn, min(n_regionkey) AS l FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey)"


def times(spark, sf_dir, links=t.hub_graph):
    return graph.shortest(links(spark, sf_dir)).filter("source <> node").select(F.col("source").alias("o"), F.col("node").alias("d"), "t")


def origins(spark, sf_dir):
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("o")).agg((F.sum(F.greatest("c_acctbal", F.lit(0.0))) / 1000).alias("made"))
    return own.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("o"), F.col("n_regionkey").alias("k")), "o")


def attractions(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("d")).agg((F.sum(F.greatest("s_acctbal", F.lit(0.0))) / 1000).alias("drawn"))
    return own.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d"), F.col("n_regionkey").alias("l")), "d")


GP = OD + ", gx AS (SELECT o, d, drawn * exp(-0.02 * t) AS x FROM tt JOIN ad USING (d)), gp AS (SELECT o, d, made * x / sum(x) OVER (PARTITION BY o) AS w FROM gx JOIN og USING (o))"


@Q.add(f"WITH RECURSIVE {GP} SELECT o, d, round(w, 6) AS w FROM gp")
def gravity_production(spark, sf_dir, links=t.hub_graph):
    return demand.production(times(spark, sf_dir, links), origins(spark, sf_dir).drop("k"), attractions(spark, sf_dir).drop("l"), 0.02).select("o", "d", R("w"))


IPF = OD + ", tot AS (SELECT (SELECT sum(made) FROM og) / (SELECT sum(drawn) FROM ad) AS f), w0 AS (SELECT o, d, made, drawn * f AS drawn, exp(-0.02 * t) AS w FROM tt JOIN og USING (o) JOIN ad USING (d), tot)"
for _k in range(1, 41):
    IPF += f", v{_k} AS MATERIALIZED (SELECT o, d, made, drawn, w * made / sum(w) OVER (PARTITION BY o) AS w FROM w{_k - 1}), w{_k} AS MATERIALIZED (SELECT o, d, made, drawn, w * drawn / sum(w) OVER (PARTITION BY d) AS w FROM v{_k})"


@Q.add(f"WITH RECURSIVE {IPF} SELECT o, d, round(w, 6) AS w FROM w40")
def gravity_ipf(spark, sf_dir, links=t.hub_graph):
    return demand.balanced(times(spark, sf_dir, links), origins(spark, sf_dir).drop("k"), attractions(spark, sf_dir).drop("l"), 0.02, tolerance=1e-12).select("o", "d", R("w"))


@Q.add(f"WITH RECURSIVE {OD}, q AS (SELECT a.r_regionkey AS k, b.r_regionkey AS l, 10.0 + a.r_regionkey * 3 + b.r_regionkey AS q FROM region a, region b), x AS (SELECT o, d, k, l, made * drawn * exp(-0.02 * t) AS x FROM tt JOIN og USING (o) JOIN ad USING (d)) SELECT o, d, round(q * x / sum(x) OVER (PARTITION BY k, l), 8) AS w FROM x JOIN q USING (k, l)")
def census_blocks(spark, sf_dir, links=t.hub_graph):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    quotas = a.crossJoin(a.select(F.col("k").alias("l"))).withColumn("q", 10.0 + F.col("k") * 3 + F.col("l"))
    return demand.blocks(times(spark, sf_dir, links), origins(spark, sf_dir), attractions(spark, sf_dir), quotas, 0.02).select("o", "d", R("w", 8))


@Q.add(f"WITH RECURSIVE {GP} SELECT round(sum(w * t) / sum(w), 6) AS mean FROM gp JOIN tt USING (o, d)")
def mean_od_time(spark, sf_dir, links=t.hub_graph):
    tt = times(spark, sf_dir, links)
    return demand.mean_time(demand.production(tt, origins(spark, sf_dir).drop("k"), attractions(spark, sf_dir).drop("l"), 0.02), tt).select(R("mean"))


def _mean_sql(beta: str, more: str = "", keys: str = "") -> str:
    """Mean time of the production model; keys are carried along."""
    return f"SELECT {keys}sum(made * m) / sum(made) AS m FROM (SELECT {keys}o, made, sum(drawn * exp(-{beta} * t) * t) / sum(drawn * exp(-{beta} * t)) AS m FROM pr{more} GROUP BY {keys}o, made)" + (f" GROUP BY {keys[:-2]}" if keys else "")


BISECTED = OD + f""", pr AS MATERIALIZED (SELECT o, d, t, made, drawn FROM tt JOIN ad USING (d) JOIN og USING (o)), tg AS MATERIALIZED (SELECT (a.m + b.m) / 2 AS target FROM ({_mean_sql('1e-5::DOUBLE')}) a, ({_mean_sql('0.02::DOUBLE')}) b),
bs AS (SELECT 0 AS k, ln(1e-5::DOUBLE) AS a, ln(0.02::DOUBLE) AS b UNION ALL SELECT k + 1, CASE WHEN m > target THEN (a + b) / 2 ELSE a END, CASE WHEN m > target THEN b ELSE (a + b) / 2 END FROM ({_mean_sql('exp((a + b) / 2)', ', bs', 'k, a, b, ')}), tg WHERE k < 44)"""


@Q.add(f"WITH RECURSIVE {BISECTED} SELECT round(target, 6) AS target, round(exp((a + b) / 2), 10) AS beta FROM bs, tg WHERE k = 44")
def calibrated_beta(spark, sf_dir, links=t.hub_graph):
    """The deterrence for which the mean time is half way between those of nearly none and of a strong one."""
    tt, og, ad = cut(times(spark, sf_dir, links)), cut(origins(spark, sf_dir).drop("k")), cut(attractions(spark, sf_dir).drop("l"))
    target = sum(demand.mean_times(tt, og, ad, [1e-5, 0.02])) / 2
    beta = demand.calibrate_beta(tt, og, ad, target, steps=44)
    return spark.createDataFrame([(target, beta)], "target double, beta double").select(R("target"), R("beta", 10))


@Q.add("WITH v AS (SELECT c_nationkey AS node, count(*)::DOUBLE AS w FROM customer GROUP BY c_nationkey), od AS (SELECT a.node AS o, b.node AS d, a.w * b.w AS w FROM v a, v b WHERE a.node <> b.node), e AS (SELECT o AS node, w / 2 AS w FROM od UNION ALL SELECT d, w / 2 FROM od) SELECT node, round(sum(w), 4) AS w FROM e GROUP BY node")
def od_normal_form(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return demand.node_mass(demand.od_from_vector(v)).select("node", R("w", 4))


@Q.add("WITH c AS (SELECT c_custkey AS cell, c_nationkey AS district, greatest(c_acctbal, 0.0) AS people FROM customer), q AS (SELECT n_nationkey AS district, 1000.0 + n_nationkey AS total FROM nation) SELECT cell, district, round(people * total / sum(people) OVER (PARTITION BY district), 6) AS people FROM c JOIN q USING (district)")
def population_rescale(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("district"), F.greatest("c_acctbal", F.lit(0.0)).alias("people"))
    totals = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district"), (1000.0 + F.col("n_nationkey")).alias("total"))
    return demand.rescale(own, totals).select("cell", "district", R("people"))


@Q.add(f"WITH {CELLS}, pj AS (SELECT n_nationkey AS project, (n_nationkey % 5) * 1000.0 + 500 AS lx, (n_nationkey // 5) * 1000.0 + 500 AS ly, 100.0 * n_regionkey AS rate FROM nation), nr AS (SELECT project, hub, count(*) OVER (PARTITION BY project) AS k, rate FROM pj, hubs WHERE sqrt((lx - rx) ** 2 + (ly - ry) ** 2) <= 600), mo AS (SELECT hub, sum(rate / k) AS more FROM nr GROUP BY hub) SELECT hub, round(10.0 + coalesce(more, 0.0), 6) AS rate FROM hubs LEFT JOIN mo USING (hub)")
def demand_overlay(spark, sf_dir):
    n = F.col("n_nationkey")
    projects = table(spark, sf_dir, "nation").select(n.alias("project"), ((n % 5) * 1000.0 + 500).alias("lx"), (F.floor(n / 5) * 1000.0 + 500).alias("ly"), (100.0 * F.col("n_regionkey")).alias("rate"))
    own = hubs(spark, sf_dir)
    near = spatial.within(projects, own, 600.0, ["project"], ["hub"])
    return demand.overlay(own.select("hub", F.lit(10.0).alias("rate")), near, projects.select("project", "rate")).select("hub", R("rate"))


@Q.add(f"WITH {t.LV} SELECT mode, n_regionkey AS grp, round(sum(dist * 2.0), 4) AS g FROM lv JOIN nation ON n_nationkey = stop GROUP BY mode, n_regionkey")
def design_matrix(spark, sf_dir):
    response = t.line_visits(spark, sf_dir).groupBy("mode", F.col("stop").alias("hub")).agg(F.sum("dist").alias("m"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("hub"), F.col("n_regionkey").alias("grp"))
    return demand.design(response, groups.select("hub", F.lit(2.0).alias("rate")), groups).select("mode", "grp", R("g", 4))


@Q.add(f"WITH {t.NP} SELECT a.node AS i, b.node AS j, round({t.haversine_sql('a', 'b')}, 3) AS m FROM np a, np b WHERE a.node < b.node")
def haversine_pairs(spark, sf_dir):
    p = t.nation_points(spark, sf_dir)
    a, b = (p.select(F.col("node").alias(f"{x}"), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in "ij")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(scalar.haversine_m("lat_i", "lon_i", "lat_j", "lon_j"), 3).alias("m"))


@Q.add(f"WITH {t.NP}, q AS (SELECT node, radians(lon::DOUBLE) * 6371000.0 * cos(radians(47.5)) AS x, radians(lat::DOUBLE) * 6371000.0 AS y FROM np) SELECT node, round(x, 4) AS x, round(y, 4) AS y, round(degrees(y / 6371000.0), 9) AS lat, round(degrees(x / (6371000.0 * cos(radians(47.5)))), 9) AS lon FROM q")
def project_points(spark, sf_dir):
    x, y = scalar.project("lat", "lon")
    own = t.nation_points(spark, sf_dir).select("node", x.alias("x"), y.alias("y"))
    lat, lon = scalar.unproject("x", "y")
    return own.select("node", R("x", 4), R("y", 4), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@Q.add(f"WITH {t.NP} SELECT node, lon > CASE WHEN lat <= 47.45::DOUBLE THEN 19.05::DOUBLE WHEN lat <= 47.5::DOUBLE THEN 19.05::DOUBLE + (lat - 47.45::DOUBLE) * ((19.15::DOUBLE - 19.05::DOUBLE) / (47.5::DOUBLE - 47.45::DOUBLE)) WHEN lat <= 47.6::DOUBLE THEN 19.15::DOUBLE + (lat - 47.5::DOUBLE) * ((19.1::DOUBLE - 19.15::DOUBLE) / (47.6::DOUBLE - 47.5::DOUBLE)) ELSE 19.1::DOUBLE END AS east FROM np")
def side_of_line(spark, sf_dir):
    return t.nation_points(spark, sf_dir).select("node", scalar.side_of_line("lon", "lat", [(19.05, 47.45), (19.15, 47.5), (19.1, 47.6)]).alias("east"))


# orders of a customer as a polyline; its segment as the route's kind
GRID = "pts AS (SELECT o_custkey AS shape, o_orderkey AS seq, (o_orderkey * 7 % 1000)::DOUBLE AS x, (o_orderkey * 13 % 1000)::DOUBLE AS y FROM orders), legs AS (SELECT shape, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY shape ORDER BY seq)), ln AS (SELECT *, greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 50.0))::INTEGER AS n FROM legs WHERE x2 IS NOT NULL), dn AS (SELECT shape, seq, k, floor((x1 + k / n * (x2 - x1)) / 100.0)::BIGINT AS a, floor((y1 + k / n * (y2 - y1)) / 100.0)::BIGINT AS b FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM ln)), st AS (SELECT shape, a, b, lead(a) OVER w AS c, lead(b) OVER w AS d FROM dn WINDOW w AS (PARTITION BY shape ORDER BY seq, k)), un AS (SELECT shape, CASE WHEN (a, b) < (c, d) THEN a ELSE c END AS ua, CASE WHEN (a, b) < (c, d) THEN b ELSE d END AS ub, CASE WHEN (a, b) < (c, d) THEN c ELSE a END AS va, CASE WHEN (a, b) < (c, d) THEN d ELSE b END AS vb FROM st WHERE c IS NOT NULL AND (a <> c OR b <> d)), ge AS (SELECT ua, ub, va, vb, count(DISTINCT CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN shape END) AS n_bus, bool_or(c_mktsegment = 'BUILDING') AS tram, bool_or(c_mktsegment = 'MACHINERY') AS trolley, sqrt((ua - va) ** 2 + (ub - vb) ** 2) * 100.0 AS length FROM un JOIN customer ON c_custkey = shape GROUP BY ua, ub, va, vb)"


def street_graph(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "tram").when(F.col("c_mktsegment") == "MACHINERY", "trolley").otherwise("bus")
    shapes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    shapes = shapes.select(F.col("o_custkey").alias("shape"), k.alias("seq"), (k * 7 % 1000).cast("double").alias("x"), (k * 13 % 1000).cast("double").alias("y"), F.col("o_custkey").alias("route"), kind.alias("kind"))
    return spatial.street_edges(shapes, 100.0, 50.0)


@Q.add(f"WITH {GRID} SELECT ua, ub, va, vb, n_bus, tram, trolley, round(length, 6) AS length FROM ge")
def grid_edges(spark, sf_dir):
    return street_graph(spark, sf_dir).select(F.col("u.a").alias("ua"), F.col("u.b").alias("ub"), F.col("v.a").alias("va"), F.col("v.b").alias("vb"), "n_bus", "tram", "trolley", R("length"))


@Q.add(f"WITH {GRID} SELECT count(*) AS n, round(sum(length), 4) AS length FROM ge WHERE tram OR trolley OR n_bus >= 3")
def main_roads(spark, sf_dir):
    return spatial.main_roads(street_graph(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 4).alias("length"))


@Q.add(f"WITH {CELLS}, p AS (SELECT r_regionkey AS polygon, r_regionkey * 1000.0 AS x0 FROM region) SELECT cell, polygon FROM cells, p WHERE lx + 0.37 > x0 + abs(ly - 2500) * 0.2 AND lx + 0.37 < x0 + 1000 - abs(ly - 2500) * 0.2 AND ly >= 0 AND ly < 5000 AND abs(ly - 2500) < 2500")
def point_in_polygon(spark, sf_dir):
    """Diamonds around the columns of cells; no point lies on an edge."""
    own = cells(spark, sf_dir).select("cell", (F.col("lx") + 0.37).alias("x"), F.col("ly").alias("y"))
    k = F.col("r_regionkey")
    corners = table(spark, sf_dir, "region").select(k.alias("polygon"), (k * 1000.0).alias("x0")).select("polygon", F.posexplode(F.array(F.struct((F.col("x0") + 500).alias("px"), F.lit(0.0).alias("py")), F.struct((F.col("x0") + 1000).alias("px"), F.lit(2500.0).alias("py")), F.struct((F.col("x0") + 500).alias("px"), F.lit(5000.0).alias("py")), F.struct(F.col("x0").alias("px"), F.lit(2500.0).alias("py")))).alias("k", "c")).select("polygon", "k", "c.px", "c.py")
    return spatial.inside(own, corners).select("cell", "polygon")


@Q.add("WITH k AS (SELECT r_regionkey * 100.0 AS t, (r_regionkey * 37 % 11)::DOUBLE AS v, lead(r_regionkey * 100.0) OVER (ORDER BY r_regionkey) AS t1, lead((r_regionkey * 37 % 11)::DOUBLE) OVER (ORDER BY r_regionkey) AS v1 FROM region), e AS (SELECT event_id, value AS x FROM events) SELECT event_id, round(coalesce(max(CASE WHEN x >= k.t AND x < k.t1 THEN v + (x - k.t) * (v1 - v) / (t1 - k.t) END), CASE WHEN max(x) < 0 THEN max(CASE WHEN k.t = 0 THEN v END) ELSE max(CASE WHEN k.t1 IS NULL THEN v END) END), 8) AS v FROM e, k GROUP BY event_id")
def interpolated(spark, sf_dir):
    curve = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 100.0).alias("t"), (F.col("r_regionkey") * 37 % 11).cast("double").alias("v"))
    at = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("t"))
    return spatial.interpolate(curve, at).select("event_id", R("v", 8))


VARIANTS = "pp AS (SELECT c_nationkey AS node, count(*)::DOUBLE AS w FROM customer GROUP BY c_nationkey), dd AS (SELECT stop AS node, (count(DISTINCT trip) / 7200.0) ** 0.5 AS w FROM lv GROUP BY stop)"


@Q.add(f"WITH RECURSIVE {SP}, {VARIANTS}, gv AS (SELECT source AS o, node AS d, w * exp(-0.02 * t) AS x FROM sp JOIN pp USING (node) WHERE source <> node) SELECT 'population' AS variant, a.node AS o, b.node AS d, round(a.w * b.w, 6) AS w FROM pp a, pp b WHERE a.node <> b.node UNION ALL SELECT 'departures', a.node, b.node, round(a.w * b.w, 6) FROM dd a, dd b WHERE a.node <> b.node UNION ALL SELECT 'population_gravity', o, d, round(pp.w * x / sum(x) OVER (PARTITION BY o), 6) FROM gv JOIN pp ON pp.node = o")
def demand_variants(spark, sf_dir):
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    served = hub_rates(spark, sf_dir).select(F.col("stop").alias("node"), F.col("mu").alias("freq"))
    own = [demand.variant(n, people, served, times(spark, sf_dir), 0.02, 0.5).select(F.lit(n).alias("variant"), "o", "d", R("w")) for n in ("population", "departures", "population_gravity")]
    return own[0].unionByName(own[1]).unionByName(own[2])


@Q.add("WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rx, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS ry FROM orders) SELECT round(corr(rx, ry), 8) AS rho FROM r")
def spearman_whole(spark, sf_dir):
    """Without groups: ranks of the whole table."""
    own = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    return stats.spearman(own, [], "x", "y").select(R("rho", 8))


@Q.add("SELECT o_orderkey, cast(rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS DOUBLE) AS rank FROM orders")
def whole_ranks(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return own.join(order.average_ranks(own, "o_custkey"), "o_custkey").select("o_orderkey", "rank")


@Q.add(f"WITH {t.NP}, x AS (SELECT p.node AS i, q.node AS j, {t.haversine_sql('p', 'q')} AS m FROM np p, np q WHERE p.node < q.node AND {t.haversine_sql('p', 'q')} <= 5000) SELECT i, j, round(m, 3) AS m FROM x")
def near_pairs(spark, sf_dir):
    return spatial.near_pairs(t.nation_points(spark, sf_dir).select("node", "lat", "lon"), 5000.0, "node").select(F.col("node_a").alias("i"), F.col("node_b").alias("j"), F.round("m", 3).alias("m"))


@Q.add("WITH RECURSIVE s AS (SELECT s_nationkey, s_suppkey, (s_suppkey * 137 % 1000)::DOUBLE AS pos, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 137 % 1000, s_suppkey) AS k FROM supplier), r AS (SELECT s_nationkey, k, pos AS last, true AS taken, s_suppkey FROM s WHERE k = 1 UNION ALL SELECT s.s_nationkey, s.k, CASE WHEN s.pos >= r.last + 150 THEN s.pos ELSE r.last END, s.pos >= r.last + 150, s.s_suppkey FROM r JOIN s ON s.s_nationkey = r.s_nationkey AND s.k = r.k + 1) SELECT s_nationkey, s_suppkey FROM r WHERE taken")
def spaced_stops(spark, sf_dir):
    """Of each nation's suppliers on a line, the first and then each at least 150 after the last one taken."""
    pos = (F.col("s_suppkey") * 137 % 1000).cast("double")
    listed = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), F.col("s_suppkey").alias("id")))).alias("line"))
    kind = listed.schema["line"].dataType.simpleString()
    return listed.select("s_nationkey", F.explode(spatial.spaced("line", 150.0, kind)).alias("x")).select("s_nationkey", F.col("x.id").alias("s_suppkey"))


def grid_sql(lat: str, lon: str) -> str:
    """scalar.hungarian_grid() step by step."""
    from math import asin, cos, log, pi, radians, sin, sqrt, tan

    (a, f), (b_a, b_f) = scalar.WGS84, scalar.GRID_ELLIPSOID
    es, gs = f * (2 - f), b_f * (2 - b_f)
    e, b = sqrt(gs), b_a * (1 - b_f)
    p0, l0 = map(radians, scalar.GRID_ORIGIN)
    c = sqrt(1 + gs * cos(p0) ** 4 / (1 - gs))
    x0 = asin(sin(p0) / c)
    k = log(tan(pi / 4 + x0 / 2)) - c * (log(tan(pi / 4 + p0 / 2)) - e / 2 * log((1 + e * sin(p0)) / (1 - e * sin(p0))))
    r = scalar.GRID_SCALE * b_a * sqrt(1 - gs) / (1 - gs * sin(p0) ** 2)
    dx, dy, dz = scalar.GRID_SHIFT
    d = lambda x: f"({x!r})::DOUBLE"
    return (
        f"g1 AS (SELECT node, radians({lat}) AS p, radians({lon}) AS l FROM np), g2 AS (SELECT node, p, l, {d(a)} / sqrt(1 - {d(es)} * sin(p) ** 2) AS n FROM g1), "
        f"g3 AS (SELECT node, n * cos(p) * cos(l) - {d(dx)} AS x, n * cos(p) * sin(l) - {d(dy)} AS y, n * {d(1 - es)} * sin(p) - {d(dz)} AS z FROM g2), "
        f"g4 AS (SELECT *, sqrt(x * x + y * y) AS h, atan2(z * {d(b_a)}, sqrt(x * x + y * y) * {d(b)}) AS th FROM g3), "
        f"g5 AS (SELECT node, atan2(z + {d(gs / (1 - gs) * b)} * sin(th) ** 3, h - {d(gs * b_a)} * cos(th) ** 3) AS p, atan2(y, x) - {d(l0)} AS l FROM g4), "
        f"g6 AS (SELECT node, {d(c)} * l AS u, 2 * atan(exp({d(c)} * (ln(tan({d(pi / 4)} + p / 2)) - {d(e / 2)} * ln((1 + {d(e)} * sin(p)) / (1 - {d(e)} * sin(p)))) + {d(k)})) - {d(pi / 2)} AS q FROM g5), "
        f"g7 AS (SELECT *, asin({d(cos(x0))} * sin(q) - {d(sin(x0))} * cos(q) * cos(u)) AS v FROM g6) "
        f"SELECT node, round({d(r)} * asin(cos(q) * sin(u) / cos(v)) + 650000, 3) AS x, round({d(r)} * ln(tan({d(pi / 4)} + v / 2)) + 200000, 3) AS y FROM g7"
    )


@Q.add(f"WITH {t.NP}, {grid_sql('lat', 'lon')}")
def hungarian_grid(spark, sf_dir):
    x, y = scalar.hungarian_grid("lat", "lon")
    return t.nation_points(spark, sf_dir).select("node", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@Q.add("WITH s AS (SELECT DISTINCT o_custkey AS shape_id, o_orderpriority AS route_id FROM orders), r AS (SELECT DISTINCT o_orderpriority AS route_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS mode FROM orders) SELECT c_custkey AS shape_id, route_id, mode FROM customer JOIN s ON shape_id = c_custkey JOIN r USING (route_id)")
def routed_shapes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    trips = orders.select(F.col("o_custkey").alias("shape_id"), F.col("o_orderpriority").alias("route_id"))
    routes = trips.select("route_id", F.substring("route_id", 1, 1).alias("route_type")).distinct()
    return spatial.routed_shapes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shape_id")), trips, routes).select("shape_id", "route_id", "mode")


@Q.add(f"WITH {GRID}, cs AS (SELECT *, (ua + 0.5) * 100.0 AS x1, (ub + 0.5) * 100.0 AS y1, (va + 0.5) * 100.0 AS x2, (vb + 0.5) * 100.0 AS y2 FROM ge) SELECT ua, ub, va, vb FROM cs WHERE tram OR NOT ((x1 <= 470 AND x2 >= 470 OR x2 <= 470 AND x1 >= 470) AND greatest(y1, y2) >= 100 AND least(y1, y2) <= 700 AND y1 + (470 - x1) / nullif(x2 - x1, 0) * (y2 - y1) BETWEEN 100 AND 700)")
def streets_over_water(spark, sf_dir):
    """Street edges without those that cross a river from (470, 100) to (470, 700), but for trams' own; the river is the border that two districts share."""
    ring = lambda x0, x1: [(x0, 100.0), (x1, 100.0), (x1, 700.0), (x0, 700.0)]
    corners = spark.createDataFrame([(p, k, *xy) for p, own in enumerate((ring(0.0, 470.0), ring(470.0, 900.0))) for k, xy in enumerate(own)], "polygon int, k int, px double, py double")
    axis = spatial.shared_borders(corners, spark.createDataFrame([(0, "west"), (1, "east")], "polygon int, side string"))
    return spatial.over_water(street_graph(spark, sf_dir), axis, 100.0).select(F.col("u.a").alias("ua"), F.col("u.b").alias("ub"), F.col("v.a").alias("va"), F.col("v.b").alias("vb"))

"""Queries: the open network, resilience, scenarios and simulation."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.functions import scalar
from railyard.operators import edges, graph
from railyard.fixpoint import cut
from railyard.plans import chain, demand, layers, linenet, links, scenario, simulate
from railyard.plans import lines as lines_of
from railyard.queries import tables as t
from railyard.queries.chains import EQ, SP, WALK, event_chain, event_rates
from railyard.queries.demand import times
from railyard.registry import Registry, table

Q = Registry()
R = lambda c, n=8: F.round(c, n).alias(c)

# the line network of the lineitem visits: a segment for each (mode, i, j), hubs are nations
NET = t.LP + """, vk AS (SELECT CAST(substr(mode, 1, 1) AS INTEGER) AS md, stop AS i, lead(stop) OVER w AS j, lead(stop, 2) OVER w AS k FROM lv WINDOW w AS (PARTITION BY trip ORDER BY dep_s, l_linenumber, l_partkey, l_suppkey)),
sg0 AS (SELECT CAST(substr(mode, 1, 1) AS INTEGER) AS md, i, j, count(*) AS n, count(*) / 7200.0::DOUBLE AS freq, greatest(median(tau_s), 20.0) AS tau, greatest(median(dist_m) * 100, 50.0) AS dist FROM lp GROUP BY 1, 2, 3),
gp0 AS (SELECT CAST(substr(mode, 1, 1) AS INTEGER) AS md, i, j, dep_s - lag(dep_s) OVER (PARTITION BY mode, i, j ORDER BY dep_s) AS gap FROM lp), cv AS (SELECT md, i, j, CASE WHEN count(*) < 3 OR avg(gap) = 0 THEN 1.0 ELSE var_pop(gap) / (avg(gap) * avg(gap)) END AS cv2 FROM gp0 GROUP BY md, i, j),
su AS (SELECT a.md, a.i, a.j, a.k, a.m / s.n AS share FROM (SELECT md, i, j, k, count(*) AS m FROM vk WHERE k IS NOT NULL GROUP BY md, i, j, k) a JOIN sg0 s USING (md, i, j) JOIN sg0 x ON x.md = a.md AND x.i = a.j AND x.j = a.k),
en AS (SELECT md, i, j, least(1.0, greatest(0.0, 1 - coalesce(sum(share), 0.0))) AS seg_end FROM sg0 LEFT JOIN su USING (md, i, j) GROUP BY md, i, j),
m1 AS (SELECT *, 2 * freq / (1 + cv2) AS theta, CASE md WHEN 1 THEN 0.40 WHEN 2 THEN 0.55 WHEN 4 THEN 1.20 ELSE 1.0 END * 1000 * tau / dist AS cost, 1 - exp(-dist / 3500.0) AS alpha FROM sg0 JOIN cv USING (md, i, j) JOIN en USING (md, i, j)),
m2 AS (SELECT *, theta * exp(-(cost - min(cost) OVER (PARTITION BY i)) / 300.0) AS q, alpha + (1 - alpha) * seg_end AS pa FROM m1), ac AS (SELECT i AS hub FROM m2 GROUP BY i HAVING sum(q) > 0),
m3 AS (SELECT m2.*, CASE WHEN ac.hub IS NULL THEN 0.0 ELSE 0.3 END AS pt, 'S' || md || '|' || m2.i || '|' || j AS s FROM m2 LEFT JOIN ac ON ac.hub = j),
ra AS (SELECT src, dst, sum(rate) AS rate FROM (SELECT 'H' || i AS src, s AS dst, q AS rate FROM m3 UNION ALL SELECT s, 'S' || su.md || '|' || su.j || '|' || su.k, (1 - alpha) * share / tau FROM m3 JOIN su ON su.md = m3.md AND su.i = m3.i AND su.j = m3.j UNION ALL SELECT s, 'H' || j, pa * pt / tau FROM m3 UNION ALL SELECT s, 'exit', pa * (1 - pt) / tau FROM m3 UNION ALL SELECT 'H' || h.hub, 'exit', 1.0 FROM (SELECT i AS hub FROM lp UNION SELECT j FROM lp) h WHERE h.hub NOT IN (SELECT hub FROM ac)) WHERE rate <> 0 GROUP BY src, dst)"""
SOURCE = ", so AS (SELECT 'H' || i AS state, sum(freq) / sum(sum(freq)) OVER () * 10.0 AS rate FROM sg0 GROUP BY i), ou AS (SELECT src AS state, sum(rate) AS hold FROM ra GROUP BY src), y AS (SELECT state, CAST(rate AS DOUBLE) AS v, 0 AS k FROM so UNION ALL SELECT ra.dst, sum(y.v * ra.rate / ou.hold), y.k + 1 FROM y JOIN ra ON ra.src = y.state JOIN ou ON ou.state = y.state WHERE ra.dst <> 'exit' AND y.k < 400 GROUP BY ra.dst, y.k + 1), ma AS (SELECT y.state, sum(v) / max(hold) AS mass FROM y JOIN ou USING (state) GROUP BY y.state)"


def line_network(spark, sf_dir) -> linenet.LineNetwork:
    mode = F.expr("CAST(substr(mode, 1, 1) AS INT)")
    visits = cut(t.line_visits(spark, sf_dir).withColumn("mode", mode).repartition("trip"))  # read, joined and dealt by trip once
    pairs = cut(edges.consecutive(visits, t.LINE_ORDER))
    key = ["mode", "i", "j"]
    stats = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.median("tau_s"), F.lit(20.0)).alias("tau_s"), F.greatest(F.median("dist_m") * 100, F.lit(50.0)).alias("dist_m"))
    cv2 = edges.headway_irregularity(pairs, key).select(*key, "cv2")
    place = t.nation_points(spark, sf_dir)
    at = lambda end: place.select(F.col("node").alias(end), F.col("lat").alias(f"lat_{end}"), F.col("lon").alias(f"lon_{end}"))
    own = stats.join(cv2, key).join(F.broadcast(at("i")), "i").join(F.broadcast(at("j")), "j")
    segments = cut(own.select(F.concat_ws("|", *key).alias("seg"), F.col("mode").cast("string").alias("route"), "mode", F.col("i").alias("from_hub"), F.col("j").alias("to_hub"), "lat_i", "lon_i", "lat_j", "lon_j", "n", (F.col("n") / 7200.0).alias("freq"), "cv2", "tau_s", "dist_m"))
    going = edges.continuation(visits, t.LINE_ORDER).filter("k is not null")
    succ = going.select(F.concat_ws("|", "route", "i", "j").alias("seg"), F.concat_ws("|", "route", "j", "k").alias("next"), "share").join(segments.select(F.col("seg").alias("next")), "next", "left_semi").select("seg", "next", "share")
    succ = cut(succ)
    hubs = place.join(pairs.select(F.explode(F.array("i", "j")).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("hub"), F.col("node").cast("string").alias("name"), "lat", "lon")
    return linenet.LineNetwork(hubs, segments, succ, 7200.0)


def source(model: linenet.OpenModel):
    return model.prior().select("hub", (F.col("share") * 10.0).alias("rate"))


@Q.add(f"WITH {NET} SELECT src, dst, round(rate, 10) AS rate FROM ra")
def subgenerator(spark, sf_dir):
    return linenet.OpenModel(line_network(spark, sf_dir)).rates.select("src", "dst", R("rate", 10))


@Q.add(f"WITH RECURSIVE {NET}{SOURCE} SELECT state, round(mass, 6) AS mass FROM ma")
def steady_state(spark, sf_dir):
    model = linenet.OpenModel(line_network(spark, sf_dir))
    return model.steady_state(source(model)).select("state", R("mass", 6))


@Q.add(f"WITH RECURSIVE {NET}{SOURCE}, f AS (SELECT md AS mode, coalesce(w.mass, 0) * q AS boarding, coalesce(r.mass, 0) / tau AS flow, coalesce(r.mass, 0) / tau * pa AS alighting FROM m3 LEFT JOIN ma r ON r.state = s LEFT JOIN ma w ON w.state = 'H' || i) SELECT mode, round(sum(boarding), 6) AS boarding, round(sum(flow), 6) AS flow, round(sum(alighting), 6) AS alighting, round(sum(boarding) / sum(sum(boarding)) OVER (), 8) AS split FROM f GROUP BY mode")
def network_flows(spark, sf_dir):
    model = linenet.OpenModel(line_network(spark, sf_dir))
    own = model.flows(model.steady_state(source(model))).groupBy("mode").agg(F.sum("boarding").alias("boarding"), F.sum("flow").alias("flow"), F.sum("alighting").alias("alighting"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("boarding").alias("all")))).select("mode", R("boarding", 6), R("flow", 6), R("alighting", 6), F.round(F.col("boarding") / F.col("all"), 8).alias("split"))


@Q.add(f"WITH RECURSIVE {NET}{SOURCE} SELECT round(sum(mass) / 10.0, 6) AS seconds FROM ma")
def journey_time(spark, sf_dir):
    model = linenet.OpenModel(line_network(spark, sf_dir))
    return model.journey_time(source(model)).select(R("seconds", 6))


@Q.add(f"WITH RECURSIVE {NET}{SOURCE}, b AS (SELECT sum(coalesce(w.mass, 0) * q) AS b FROM m3 LEFT JOIN ma w ON w.state = 'H' || i) SELECT CAST(substr(state, 2) AS INTEGER) AS hub, round(rate * 25.0 / b, 8) AS rate FROM so, b")
def scaled_source(spark, sf_dir):
    """The source that gives 25 boardings a second."""
    model = linenet.OpenModel(line_network(spark, sf_dir))
    return model.scaled_to_boardings(source(model), 25.0).select("hub", R("rate"))


@Q.add(f"WITH {NET} SELECT i AS hub, round(sum(freq) ** 0.7 / sum(sum(freq) ** 0.7) OVER (), 10) AS share FROM sg0 GROUP BY i")
def departure_prior(spark, sf_dir):
    return linenet.OpenModel(line_network(spark, sf_dir)).prior(0.7).select("hub", R("share", 10))


@Q.add(f"WITH RECURSIVE {NET}, ou AS (SELECT src AS state, sum(rate) AS hold FROM ra GROUP BY src), y AS (SELECT md, 'H' || i AS state, sum(q / hold) AS v, 0 AS k FROM m3 JOIN ou ON state = 'H' || i GROUP BY md, i UNION ALL SELECT y.md, ra.src, sum(y.v * ra.rate / ou.hold), y.k + 1 FROM y JOIN ra ON ra.dst = y.state JOIN ou ON ou.state = ra.src WHERE y.k < 400 GROUP BY y.md, ra.src, y.k + 1) SELECT md AS mode, CAST(substr(state, 2) AS INTEGER) AS hub, round(sum(v), 7) AS m FROM y WHERE state LIKE 'H%' GROUP BY md, state")
def mode_response(spark, sf_dir):
    """Expected boardings of each mode by a passenger from each hub."""
    return linenet.OpenModel(line_network(spark, sf_dir)).mode_response([1, 2, 3, 4, 5]).select("mode", F.col("hub").cast("int").alias("hub"), R("m", 7))


def totals_sql(t: float, terms: int) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {NET}{SOURCE}, tr AS (SELECT max(hold) AS top FROM ou), st AS (SELECT src, dst, rate / top AS p FROM ra, tr WHERE dst <> 'exit' UNION ALL SELECT state, state, 1 - hold / top FROM ou, tr), z AS (SELECT state, mass AS v, 0 AS k, exp(-top * {t}) AS w FROM ma, tr UNION ALL SELECT st.dst, sum(z.v * st.p), z.k + 1, max(z.w * top * {t} / (z.k + 1)) FROM z JOIN st ON st.src = z.state, tr WHERE z.k < {terms} GROUP BY st.dst, z.k + 1) SELECT {t}::DOUBLE AS t, round((SELECT sum(mass) FROM ma) - sum(w * v), 5) AS n FROM z)"


@Q.add(" UNION ALL ".join([totals_sql(20.0, 120), totals_sql(60.0, 220)]))
def transient_people(spark, sf_dir):
    """People in the network after 20 and 60 seconds of a cold start."""
    model = linenet.OpenModel(line_network(spark, sf_dir))
    mass = model.steady_state(source(model))
    # nodes nobody gets to start from must be there all the same
    padded = model.rates.select(F.col("src").alias("state")).distinct().join(mass, "state", "left").select("state", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    return model.transient_totals(padded, [20.0, 60.0]).select("t", R("n", 5))


@Q.add(f"WITH {NET} SELECT src, dst, round(rate / sum(rate) OVER (PARTITION BY src), 9) AS p FROM ra")
def jump_chain(spark, sf_dir):
    return linenet.OpenModel(line_network(spark, sf_dir)).jump_chain().select("src", "dst", R("p", 9))


ODW = ", ow AS (SELECT a.c_nationkey AS o, b.c_nationkey AS d, (a.n * b.n)::DOUBLE AS w FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) a, (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) b WHERE a.c_nationkey <> b.c_nationkey)"
FAILED = ", nd AS (SELECT i AS k FROM sg UNION SELECT j FROM sg), x AS (SELECT r.k AS closed, s.k AS source, s.k AS node, 0.0::DOUBLE AS t, 0 AS h FROM nd r, nd s WHERE r.k <> s.k UNION ALL SELECT x.closed, x.source, sg.j, min(x.t + sg.cost), x.h + 1 FROM x JOIN sg ON x.node = sg.i WHERE sg.j <> x.closed AND x.h < 24 GROUP BY x.closed, x.source, sg.j, x.h + 1), ft AS (SELECT closed, source AS o, node AS d, min(t) AS t FROM x WHERE source <> node GROUP BY closed, source, node), tt AS (SELECT source AS o, node AS d, t FROM sp WHERE source <> node)"
FAIL = SP + ODW + FAILED


def weights(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return demand.od_from_vector(v)


def times_of(links):
    return cut(graph.shortest(links).filter("source <> node").select(F.col("source").alias("o"), F.col("node").alias("d"), "t"))


def failure_sums(links, od):
    """(o, d, t), and (k, before, after): sums of w / t over the pairs that don't touch a hub, with it and without it."""
    tree = cut(graph.shortest(links))
    base = tree.filter("source <> node").select(F.col("source").alias("o"), F.col("node").alias("d"), "t")
    return base, scenario.after_failures(base, graph.failures(links, tree), od)


@Q.add(f"WITH RECURSIVE {FAIL}, e0 AS (SELECT sum(w / t) / (SELECT sum(w) FROM ow) AS e FROM tt JOIN ow USING (o, d)), a AS (SELECT closed, sum(w / t) / (SELECT sum(w) FROM ow) AS e, sum(CASE WHEN o <> closed AND d <> closed THEN w / t END) AS n FROM ft JOIN ow USING (o, d) GROUP BY closed), b AS (SELECT k AS closed, sum(CASE WHEN o <> k AND d <> k THEN w / t END) AS n FROM tt JOIN ow USING (o, d), nd GROUP BY k) SELECT a.closed, round(1 - a.e / e0.e, 8) AS loss, round(1 - a.n / b.n, 8) AS network_loss FROM a JOIN b USING (closed), e0")
def closure_loss(spark, sf_dir):
    links, od = t.hub_graph(spark, sf_dir), weights(spark, sf_dir)
    base, sums = failure_sums(links, od)
    sums = sums.crossJoin(F.broadcast(base.join(od, ["o", "d"]).agg(F.sum(F.col("w") / F.col("t")).alias("all"))))
    return sums.select(F.col("k").alias("closed"), F.round(1 - F.col("after") / F.col("all"), 8).alias("loss"), F.round(1 - F.col("after") / F.col("before"), 8).alias("network_loss"))


# closed hubs of the open network: vehicles pass without stopping for passengers, or don't run there at all
SHUT = """, cl AS (SELECT 3 AS c UNION ALL SELECT 7), sc AS (SELECT c, 'closure' AS how FROM cl UNION ALL SELECT c, 'failure' FROM cl UNION ALL SELECT -1, 'none'),
ok AS (SELECT c, how, md, i, j, theta, tau, s FROM m3, sc WHERE NOT (how = 'failure' AND (i = c OR j = c))),
te AS (SELECT c, how, 'H' || i AS a, s AS b, 1 / theta AS t FROM ok WHERE theta > 0 AND i <> c UNION ALL SELECT c, how, s, 'H' || j, tau FROM ok WHERE j <> c UNION ALL SELECT x.c, x.how, x.s, y.s, x.tau FROM ok x JOIN su ON su.md = x.md AND su.i = x.i AND su.j = x.j JOIN ok y ON y.c = x.c AND y.how = x.how AND y.md = su.md AND y.i = su.j AND y.j = su.k),
wk AS (SELECT DISTINCT c, how, a AS source, a AS node, 0.0::DOUBLE AS t, 0 AS k FROM te WHERE a LIKE 'H%' UNION ALL SELECT wk.c, wk.how, wk.source, te.b, min(wk.t + te.t), wk.k + 1 FROM wk JOIN te ON te.c = wk.c AND te.how = wk.how AND te.a = wk.node WHERE wk.k < 12 GROUP BY wk.c, wk.how, wk.source, te.b, wk.k + 1),
ht AS (SELECT c, how, substr(source, 2) AS o, substr(node, 2) AS d, min(t) AS t FROM wk WHERE node LIKE 'H%' AND node <> source GROUP BY c, how, source, node)"""
ODS = ", ow AS (SELECT CAST(a.c_nationkey AS VARCHAR) AS o, CAST(b.c_nationkey AS VARCHAR) AS d, (a.n * b.n)::DOUBLE AS w FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) a, (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) b WHERE a.c_nationkey <> b.c_nationkey)"


@Q.add(f"WITH RECURSIVE {NET}{SHUT}{ODS}, e0 AS (SELECT sum(w / t) AS e FROM ht JOIN ow USING (o, d) WHERE how = 'none'), a AS (SELECT c, how, sum(w / t) AS e, sum(CASE WHEN o <> CAST(c AS VARCHAR) AND d <> CAST(c AS VARCHAR) THEN w / t END) AS n FROM ht JOIN ow USING (o, d) WHERE how <> 'none' GROUP BY c, how), b AS (SELECT cl.c, sum(w / t) AS n FROM ht JOIN ow USING (o, d), cl WHERE how = 'none' AND o <> CAST(cl.c AS VARCHAR) AND d <> CAST(cl.c AS VARCHAR) GROUP BY cl.c) SELECT CAST(a.c AS VARCHAR) AS closed, how AS scenario, round(1 - a.e / e0.e, 8) AS loss, round(1 - a.n / b.n, 8) AS network_loss FROM a JOIN b ON a.c = b.c, e0")
def closure_and_failure(spark, sf_dir):
    """Both scenarios for two hubs of the whole line network."""
    model = linenet.OpenModel(line_network(spark, sf_dir))
    asked = spark.createDataFrame([(k, how) for k in (3, 7) for how in ("closure", "failure")], "closed int, scenario string")
    od = weights(spark, sf_dir).select(F.col("o").cast("string").alias("o"), F.col("d").cast("string").alias("d"), "w")
    base, closed = cut(model.hub_times()), cut(model.hub_times(asked))
    return linenet.closure_loss(base, closed, od).select("closed", "scenario", R("loss"), R("network_loss"))


VUL = FAIL + ", a AS (SELECT closed AS k, sum(w / t) AS n FROM ft JOIN ow USING (o, d) WHERE o <> closed AND d <> closed GROUP BY closed), b AS (SELECT k, sum(w / t) AS n FROM tt JOIN ow USING (o, d), nd WHERE o <> k AND d <> k GROUP BY k), v AS (SELECT k, 1 - coalesce(a.n / b.n, 0) AS v FROM b LEFT JOIN a USING (k))"


def hub_vulnerability(spark, sf_dir, od=None):
    links = t.hub_graph(spark, sf_dir)
    return scenario.vulnerability_of(failure_sums(links, od if od is not None else weights(spark, sf_dir))[1])


@Q.add(f"WITH RECURSIVE {VUL} SELECT k, round(v, 8) AS v FROM v")
def vulnerability(spark, sf_dir):
    return hub_vulnerability(spark, sf_dir).select("k", R("v"))


@Q.add(f"WITH RECURSIVE {VUL} SELECT round(0.5 * avg(v) + 0.5 * max(v), 8) AS j FROM v")
def vulnerability_j(spark, sf_dir):
    return scenario.risk(hub_vulnerability(spark, sf_dir)).select(R("j"))


ALPHAS = (0.0, 0.5, 1.0)


@Q.add(f"WITH RECURSIVE {VUL.replace('(a.n * b.n)::DOUBLE AS w', '1.0::DOUBLE AS w')}, al AS (SELECT unnest({list(ALPHAS)}::DOUBLE[]) AS alpha) SELECT alpha, round(alpha * avg(v) + (1 - alpha) * max(v), 8) AS j FROM v, al GROUP BY alpha")
def risk_sensitivity(spark, sf_dir):
    """The risk with all pairs alike, for several weights of mean against maximum."""
    alike = weights(spark, sf_dir).withColumn("w", F.lit(1.0))
    v = cut(hub_vulnerability(spark, sf_dir, alike))
    own = [scenario.risk(v, a).select(F.lit(a).alias("alpha"), R("j")) for a in ALPHAS]
    return own[0].unionByName(own[1]).unionByName(own[2])


RSP = t.RG + WALK
TIMES = ", tt AS (SELECT source AS o, node AS d, t FROM sp WHERE source <> node)"
LACKING = f", nw AS (SELECT least(o, d) AS a, greatest(o, d) AS b, min(t) AS now FROM tt GROUP BY 1, 2), cl AS (SELECT p.node AS a, q.node AS b, 0.001 * {t.haversine_sql('p', 'q')} AS c, {t.haversine_sql('p', 'q')} AS m FROM np p, np q WHERE p.node < q.node AND {t.haversine_sql('p', 'q')} BETWEEN 150 AND 9000 AND NOT EXISTS (SELECT 1 FROM sg WHERE least(i, j) = p.node AND greatest(i, j) = q.node)), cd AS (SELECT a, b, c, m FROM cl LEFT JOIN nw USING (a, b) WHERE coalesce(now >= 1.5 * c, true))"
CAND = f", {t.NP}{TIMES}{LACKING}"


def link_candidates(spark, sf_dir, links, base):
    return scenario.candidate_links(t.nation_points(spark, sf_dir).select("node", "lat", "lon"), links, base, 0.001, 150.0, 9000.0)


@Q.add(f"WITH RECURSIVE {RSP}{CAND} SELECT a, b, round(c, 8) AS c, round(m, 4) AS m FROM cd")
def candidate_links(spark, sf_dir):
    links = t.regional_graph(spark, sf_dir)
    return link_candidates(spark, sf_dir, links, times_of(links)).select("a", "b", R("c"), R("m", 4))


INSERTED = ", fu AS (SELECT * FROM tt UNION ALL SELECT DISTINCT o, o, 0.0 FROM (SELECT o FROM tt UNION SELECT d FROM tt UNION SELECT a FROM cd UNION SELECT b FROM cd)), bo AS (SELECT a, b, a AS p, b AS q, c FROM cd UNION ALL SELECT a, b, b, a, c FROM cd), nt AS (SELECT a, b, o, d, min(t) AS t FROM (SELECT bo.a, bo.b, f.o, g.d, f.t + bo.c + g.t AS t FROM bo JOIN fu f ON f.d = bo.p JOIN fu g ON g.o = bo.q WHERE f.o <> g.d UNION ALL SELECT cd.a, cd.b, o, d, t FROM tt, cd) GROUP BY a, b, o, d)"


@Q.add(f"WITH RECURSIVE {RSP}{ODW}{CAND}{INSERTED} SELECT a, b, round(sum(w / t) / (SELECT sum(w) FROM ow), 10) AS e FROM nt JOIN ow USING (o, d) GROUP BY a, b")
def edge_insert_minplus(spark, sf_dir):
    links = t.regional_graph(spark, sf_dir)
    base = times_of(links)
    more = cut(link_candidates(spark, sf_dir, links, base).select(F.col("a").alias("ka"), F.col("b").alias("kb"), "a", "b", "c"))
    changed = scenario.insert_links(base, more, ("ka", "kb"))
    return scenario.efficiency(changed, weights(spark, sf_dir), ("ka", "kb")).select(F.col("ka").alias("a"), F.col("kb").alias("b"), R("e", 10))


def line_stations(spark, sf_dir):
    """A line through the nations of each region, two minutes from one to the next."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("hub"), (2.0 * F.row_number().over(w)).alias("cum"))


LINES = ", fu AS (SELECT * FROM tt UNION ALL SELECT DISTINCT o, o, 0.0 FROM (SELECT o FROM tt UNION SELECT d FROM tt UNION SELECT n_nationkey FROM nation)), st AS (SELECT n_regionkey AS r, n_nationkey AS hub, 2.0 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS cum FROM nation), ll AS (SELECT x.r, x.hub AS a, y.hub AS b, 1.5 + abs(x.cum - y.cum) AS c FROM st x JOIN st y ON x.r = y.r WHERE x.hub <> y.hub), nt AS (SELECT r, o, d, min(t) AS t FROM (SELECT r, tt.* FROM tt, (SELECT DISTINCT r FROM st) UNION ALL SELECT ll.r, f.o, g.d, f.t + ll.c + g.t FROM ll JOIN fu f ON f.d = ll.a JOIN fu g ON g.o = ll.b WHERE f.o <> g.d) GROUP BY r, o, d), e0 AS (SELECT sum(w / t) AS e FROM tt JOIN ow USING (o, d)), gn AS (SELECT r, sum(w / t) / (SELECT e FROM e0) - 1 AS gain FROM nt JOIN ow USING (o, d) GROUP BY r)"


@Q.add(f"WITH RECURSIVE {SP}{ODW}{TIMES}{LINES} SELECT round(gain, 9) AS gain FROM gn WHERE r = 0")
def line_minplus_gain(spark, sf_dir):
    base, od = times_of(t.hub_graph(spark, sf_dir)), weights(spark, sf_dir)
    changed = scenario.insert_line(base, scenario.line_links(line_stations(spark, sf_dir).filter("n_regionkey = 0"), 3.0))
    e0 = scenario.efficiency(base, od).select(F.col("e").alias("e0"))
    return scenario.efficiency(changed, od).crossJoin(e0).select(F.round(F.col("e") / F.col("e0") - 1, 9).alias("gain"))


def dense_times(base, names, od):
    w = scenario.matrix(od.select("o", "d", F.col("w").alias("t")), names)
    w[~np.isfinite(w)] = 0
    return scenario.matrix(base, names), w


def region_lines(spark, sf_dir):
    """The network, and the regions' lines as candidates with prices."""
    base, od = times_of(t.hub_graph(spark, sf_dir)), weights(spark, sf_dir)
    names = sorted(r[0] for r in t.nation_points(spark, sf_dir).select("node").collect())
    at = F.element_at(F.create_map(*(F.lit(x) for pair in ((n, k) for k, n in enumerate(names)) for x in pair)), F.col("hub"))
    lines = line_stations(spark, sf_dir).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("cum", at.alias("at")))).alias("s"))
    lines = lines.select(F.col("n_regionkey").cast("long").alias("id"), F.transform("s", lambda x: x["at"]).alias("stations"), F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: F.lit(2.0)).alias("seconds"), F.lit(3.0).alias("headway"))
    price = (5.0 + F.col("id")) * F.when(F.col("id") % 2 == 0, 10).otherwise(1)
    return lines_of.Network(*dense_times(base, names, od)), lines.withColumn("price", price)


def line_gains(spark, sf_dir):
    """(id, gain) of the regions' lines, each alone, from tasks that share the matrix."""
    return lines_of.gains(*region_lines(spark, sf_dir))


@Q.add(f"WITH RECURSIVE {SP}{ODW}{TIMES}{LINES} SELECT CAST(r AS BIGINT) AS id, round(gain, 9) AS gain FROM gn")
def first_gains(spark, sf_dir):
    return line_gains(spark, sf_dir).select("id", R("gain", 9))


RANKED = ", gl AS (SELECT 'L' || r AS line, CASE WHEN r % 2 = 0 THEN 'metro' ELSE 'tram' END AS kind, 5.0 + r AS km, gain, (5.0 + r) * CASE WHEN r % 2 = 0 THEN 10 ELSE 1 END AS cost FROM gn), rt AS (SELECT unnest([5.0, 20.0, NULL]::DOUBLE[]) AS ratio), bs AS (SELECT line FROM gl ORDER BY gain / cost DESC, line LIMIT 2), rk AS (SELECT ratio, line, row_number() OVER (PARTITION BY ratio ORDER BY gain / CASE WHEN ratio IS NULL THEN 1.0 WHEN kind = 'metro' THEN km * ratio ELSE km END DESC, line) AS rank FROM gl, rt)"


@Q.add(f"WITH RECURSIVE {SP}{ODW}{TIMES}{LINES}{RANKED} SELECT ratio, line, CAST(rank AS INTEGER) AS rank, line IN (SELECT line FROM bs) AS in_base FROM rk WHERE rank <= 2")
def reranked_lines(spark, sf_dir):
    """The two best lines by gain per cost at other costs of a kilometre, and by gain alone."""
    r = F.col("id")
    own = line_gains(spark, sf_dir).select(F.concat(F.lit("L"), r.cast("string")).alias("line"), F.when(r % 2 == 0, "metro").otherwise("tram").alias("kind"), (5.0 + r).alias("km"), "gain", ((5.0 + r) * F.when(r % 2 == 0, 10).otherwise(1)).alias("cost"))
    return layers.reranked(cut(own), [5.0, 20.0], 2)


VARIANTS = ", vw AS (SELECT 'customers' AS variant, c_nationkey AS node, count(*)::DOUBLE AS w FROM customer GROUP BY c_nationkey UNION ALL SELECT 'suppliers', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'alike', n_nationkey, 1 FROM nation), vo AS (SELECT a.variant, a.node AS o, b.node AS d, a.w * b.w AS w FROM vw a JOIN vw b ON a.variant = b.variant AND a.node <> b.node), u0 AS (SELECT * FROM tt)"
for _r in range(5):  # one line after the other
    VARIANTS += f", f{_r} AS (SELECT * FROM u{_r} UNION ALL SELECT n_nationkey, n_nationkey, 0.0 FROM nation), u{_r + 1} AS MATERIALIZED (SELECT o, d, min(t) AS t FROM (SELECT * FROM u{_r} UNION ALL SELECT f.o, g.d, f.t + ll.c + g.t FROM ll JOIN f{_r} f ON f.d = ll.a JOIN f{_r} g ON g.o = ll.b WHERE f.o <> g.d AND ll.r = {_r}) GROUP BY o, d)"
VARIANTS += ", v0 AS (SELECT variant, sum(w / t) AS e0 FROM tt JOIN vo USING (o, d) GROUP BY variant), v1 AS (SELECT variant, r AS line, sum(w / t) / max(e0) - 1 AS gain FROM nt JOIN vo USING (o, d) JOIN v0 USING (variant) GROUP BY variant, r), v2 AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY round(gain, 12) DESC, line) AS rank FROM v1), v3 AS (SELECT variant, sum(w / t) / max(e0) - 1 AS together FROM u5 JOIN vo USING (o, d) JOIN v0 USING (variant) GROUP BY variant)"


@Q.add(f"WITH RECURSIVE {SP}{ODW}{TIMES}{LINES}{VARIANTS} SELECT variant, line, round(gain, 9) AS gain, CAST(rank AS INTEGER) AS rank, CAST(max(rank) OVER (PARTITION BY line) AS INTEGER) AS worst, round(together, 9) AS together, round(together / sum(gain) OVER (PARTITION BY variant), 7) AS interaction FROM v2 JOIN v3 USING (variant)")
def plan_evaluation(spark, sf_dir):
    """The regions' lines alone and together, with pairs weighed by customers, by suppliers and alike."""
    links_ = cut(scenario.line_links(line_stations(spark, sf_dir).withColumnRenamed("n_regionkey", "line"), 3.0, ["line"]))
    base = times_of(t.hub_graph(spark, sf_dir))
    package = base
    for line in sorted(r[0] for r in links_.select("line").distinct().collect()):  # the lines of the plan
        package = cut(scenario.insert_line(package, links_.filter(F.col("line") == line).drop("line")))
    count = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    weighed = {"customers": count("customer", "c_nationkey"), "suppliers": count("supplier", "s_nationkey"), "alike": t.nation_points(spark, sf_dir).select("node", F.lit(1.0).alias("w"))}
    od = None
    for name, vector in weighed.items():
        own = demand.od_from_vector(vector).withColumn("variant", F.lit(name))
        od = own if od is None else od.unionByName(own)
    made = layers.evaluation(base, scenario.insert_line(base, links_, ["line"]), package, cut(od))
    return made.select("variant", "line", R("gain", 9), "rank", "worst", R("together", 9), R("interaction", 7))


PICKED = """, p1 AS (SELECT r, gain FROM gn ORDER BY gain / ((5.0 + r) * CASE WHEN r % 2 = 0 THEN 10 ELSE 1 END) DESC, r LIMIT 1), t1 AS (SELECT o, d, t FROM nt JOIN p1 USING (r)), f1 AS (SELECT * FROM t1 UNION ALL SELECT DISTINCT o, o, 0.0 FROM (SELECT o FROM t1 UNION SELECT d FROM t1 UNION SELECT n_nationkey FROM nation)),
n2 AS (SELECT r, o, d, min(t) AS t FROM (SELECT r, t1.* FROM t1, (SELECT DISTINCT r FROM st) UNION ALL SELECT ll.r, f.o, g.d, f.t + ll.c + g.t FROM ll JOIN f1 f ON f.d = ll.a JOIN f1 g ON g.o = ll.b WHERE f.o <> g.d) WHERE r NOT IN (SELECT r FROM p1) GROUP BY r, o, d),
g2 AS (SELECT r, sum(w / t) / (SELECT e FROM e0) - 1 - (SELECT gain FROM p1) AS gain FROM n2 JOIN ow USING (o, d) GROUP BY r), p2 AS (SELECT r, gain FROM g2 ORDER BY gain / ((5.0 + r) * CASE WHEN r % 2 = 0 THEN 10 ELSE 1 END) DESC, r LIMIT 1)"""


@Q.add(f"WITH RECURSIVE {SP}{ODW}{TIMES}{LINES}{PICKED} SELECT 0 AS step, CAST(r AS BIGINT) AS id, round(gain, 9) AS marginal, round(gain, 9) AS total FROM p1 UNION ALL SELECT 1, CAST(p2.r AS BIGINT), round(p2.gain, 9), round(p1.gain + p2.gain, 9) FROM p2, p1")
def greedy_lines(spark, sf_dir):
    """The two lines of most gain for their price, the second given the first."""
    steps = lines_of.best_lines(*region_lines(spark, sf_dir), 2)
    made = spark.createDataFrame([(x["step"], x["id"], x["marginal"], x["total"]) for x in steps], "step int, id long, marginal double, total double")
    return made.select("step", "id", R("marginal", 9), R("total", 9))


CORRIDOR_POINTS = f"{t.NP}, pt AS (SELECT node AS hub, radians(lon) * 6371000.0 * cos(radians(47.5)) AS x, radians(lat) * 6371000.0 AS y, n::DOUBLE AS weight FROM np JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) ON c_nationkey = node)"


@Q.add(f"WITH RECURSIVE {CORRIDOR_POINTS}, pr AS (SELECT a.hub AS a, b.hub AS b, a.x AS ax, a.y AS ay, b.x AS cx, b.y AS cy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM pt a JOIN pt b ON a.hub < b.hub), pq AS (SELECT * FROM pr WHERE 1.1 * len BETWEEN 4000 AND 14000), nr AS (SELECT * FROM (SELECT pq.*, hub, x, y, weight, ((x - ax) * (cx - ax) + (y - ay) * (cy - ay)) / len AS along, abs((y - ay) * (cx - ax) - (x - ax) * (cy - ay)) / len AS across FROM pq, pt) WHERE along > 0 AND along < len AND across <= 900), rn AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY weight DESC, hub) AS k FROM nr), r AS (SELECT a, b, 0 AS k, [struct_pack(along := 0.0::DOUBLE, hub := a, x := ax, y := ay), struct_pack(along := len, hub := b, x := cx, y := cy)] AS taken FROM pq UNION ALL SELECT r.a, r.b, r.k + 1, CASE WHEN len(list_filter(r.taken, lambda c: sqrt((c.x - n.x) ** 2 + (c.y - n.y) ** 2) < 1200)) = 0 THEN list_append(r.taken, struct_pack(along := n.along, hub := n.hub, x := n.x, y := n.y)) ELSE r.taken END FROM r JOIN rn n ON n.a = r.a AND n.b = r.b AND n.k = r.k + 1), z AS (SELECT a, b, arg_max(taken, k) AS taken FROM r GROUP BY a, b) SELECT a, b, array_to_string(list_transform(list_sort(list_transform(taken, lambda c: struct_pack(along := c.along, hub := c.hub))), lambda c: c.hub), ',') AS hubs FROM z")
def corridor_candidates(spark, sf_dir):
    """Straight lines between nations' places with the places near their axes."""
    x, y = scalar.project("lat", "lon")
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    points = t.nation_points(spark, sf_dir).join(people, "node").select(F.col("node").alias("hub"), x.alias("x"), y.alias("y"), "weight")
    return scenario.corridors(points, points, 1200.0, 900.0, 4000.0, 14000.0, 1.1).select("a", "b", F.array_join(F.transform("hubs", lambda h: h.cast("string")), ",").alias("hubs"))


def link_scorer(spark, sf_dir):
    """A scorer of the regional network's links with its candidates, as places in the list of nations."""
    edges_ = t.regional_graph(spark, sf_dir)
    tree = cut(graph.shortest(edges_))
    base = tree.filter("source <> node").select(F.col("source").alias("o"), F.col("node").alias("d"), "t")
    names = sorted(r[0] for r in t.nation_points(spark, sf_dir).select("node").collect())  # places without edges may get links too
    at = {n: k for k, n in enumerate(names)}
    dense, w = dense_times(base, names, weights(spark, sf_dir))
    nodes = edges_.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    tried = [(at[r["a"]], at[r["b"]], r["c"]) for r in link_candidates(spark, sf_dir, edges_, base).orderBy("a", "b").collect()]
    return links.Scorer(names, dense, w, cut(graph.failures(edges_, tree)), nodes), tried, names


RISKS = f"{RSP}{ODW}{FAILED}, {t.NP}{LACKING}{INSERTED}, ff AS (SELECT * FROM ft UNION ALL SELECT k, o, o, 0.0 FROM nd, (SELECT DISTINCT o FROM fu) WHERE o <> k), fn AS (SELECT a, b, closed, o, d, min(t) AS t FROM (SELECT bo.a, bo.b, f.closed, f.o, g.d, f.t + bo.c + g.t AS t FROM bo JOIN ff f ON f.d = bo.p JOIN ff g ON g.o = bo.q AND g.closed = f.closed WHERE f.o <> g.d AND f.closed NOT IN (bo.a, bo.b) UNION ALL SELECT cd.a, cd.b, closed, o, d, t FROM ft, cd) GROUP BY a, b, closed, o, d), aw AS (SELECT a, b, closed AS k, sum(w / t) AS n FROM fn JOIN ow USING (o, d) GROUP BY a, b, closed), bw AS (SELECT a, b, k, sum(w / t) AS n FROM nt JOIN ow USING (o, d), nd WHERE o <> k AND d <> k GROUP BY a, b, k), vv AS (SELECT a, b, k, 1 - coalesce(aw.n / bw.n, 0) AS v FROM bw LEFT JOIN aw USING (a, b, k)), js AS (SELECT a, b, 0.5 * avg(v) + 0.5 * max(v) AS j FROM vv GROUP BY a, b)"


def greedy_sql(steps: int) -> str:
    """The best of all candidates, put into the times of the whole network and of each failure; then the best of those left, and so on."""
    begin = RISKS.index(INSERTED)
    out, told = RISKS[:begin], []
    for k in range(steps):
        own = re.sub(r"\b(fu|bo|nt|ff|fn|aw|bw|vv|js|tt|ft|cd)\b", rf"\g<1>{k or ''}", RISKS[begin:])
        at = k or ""
        out += f"{own}, be{k} AS (SELECT a, b, c, j FROM js{at} JOIN cd{at} USING (a, b) ORDER BY round(j, 12), a, b LIMIT 1), tt{k + 1} AS (SELECT o, d, t FROM nt{at} JOIN be{k} USING (a, b)), ft{k + 1} AS (SELECT closed, o, d, t FROM fn{at} JOIN be{k} USING (a, b)), cd{k + 1} AS (SELECT cd{at}.* FROM cd{at} ANTI JOIN be{k} USING (a, b))"
        told.append(f"SELECT {k} AS step, a, b, round(c, 8) AS c, round(j, 8) AS j FROM be{k}")
    return f"{out} {' UNION ALL '.join(told)}"


@Q.add(f"WITH RECURSIVE {greedy_sql(3)}")
def greedy_links(spark, sf_dir):
    """The three links that lower the regional network's risk most, one after the other."""
    scorer, tried, names = link_scorer(spark, sf_dir)
    picked = scorer.best(tried, 3)
    return spark.createDataFrame([(n, names[a], names[b], float(c), float(j)) for n, ((a, b, c), j) in enumerate(picked)], "step int, a int, b int, c double, j double").select("step", "a", "b", R("c"), R("j"))


@Q.add(f"WITH RECURSIVE {RISKS} SELECT a, b, round(j, 8) AS j FROM js")
def link_risks(spark, sf_dir):
    """The risk of the regional network with each candidate, scored in tasks: its least is the first step of greedy_links."""
    scorer, tried, names = link_scorer(spark, sf_dir)
    rows = spark.createDataFrame([(n, names[a], names[b]) for n, (a, b, _) in enumerate(tried)], "id long, a int, b int")
    return scorer.singles(tried).join(rows, "id").select("a", "b", R("j"))


@Q.add()
def link_pairs(spark, sf_dir):
    """The risk with each pair of candidates."""
    scorer, tried, names = link_scorer(spark, sf_dir)
    named = spark.createDataFrame([(n, f"{names[a]}-{names[b]}") for n, (a, b, _) in enumerate(tried)], "id long, link string")
    pairs = scorer.pairs(tried)
    return pairs.join(named.withColumnsRenamed({"id": "m", "link": "first"}), "m").join(named.withColumnsRenamed({"id": "n", "link": "second"}), "n").select("first", "second", R("j"))


@Q.add(f"WITH {t.HC}, {t.NP}, st AS (SELECT n_regionkey AS r, n_nationkey AS hub, lat, lon, row_number() OVER w - 1 AS k, lead(n_nationkey) OVER w AS h2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation JOIN np ON node = n_nationkey WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)), sx AS (SELECT r, k, n, hub, h2, CASE WHEN r % 2 = 0 THEN 1.1 ELSE 1.2 END * {t.HAVERSINE.format(lat1='lat', lon1='lon', lat2='lat2', lon2='lon2')} AS m, CASE WHEN r % 2 = 0 THEN 33.0 ELSE 18.0 END / 3.6 AS speed, CASE WHEN r % 2 = 0 THEN 180.0 ELSE 300.0 END AS hw, CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END AS mode FROM st WHERE h2 IS NOT NULL), nl AS (SELECT r, 0 AS way, k, mode, hub AS f, h2 AS g, m, speed, hw, n FROM sx UNION ALL SELECT r, 1, n - 2 - k, mode, h2, hub, m, speed, hw, n FROM sx WHERE r <> 4) SELECT 'NEW:L' || r || '|' || way || '|' || k AS seg, mode, f AS from_hub, g AS to_hub, CAST(round_even(7200 / hw, 0) AS BIGINT) AS n, round(1 / hw, 9) AS freq, round(greatest(20.0, m / speed), 5) AS tau_s, round(m, 3) AS dist_m, CASE WHEN k < n - 2 THEN 'NEW:L' || r || '|' || way || '|' || (k + 1) END AS next FROM nl")
def new_lines(spark, sf_dir):
    """A line through each region's nations in the network, that of the last region one way only."""
    net = line_network(spark, sf_dir)
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    r = F.col("n_regionkey")
    stations = table(spark, sf_dir, "nation").select(F.concat(F.lit("L"), r.cast("string")).alias("line"), F.when(r % 2 == 0, "metro").otherwise("tram").alias("kind"), F.row_number().over(w).alias("k"), F.col("n_nationkey").alias("hub"), (r == 4).alias("one_way"))
    places = t.nation_points(spark, sf_dir).select(F.col("node").alias("hub"), "lat", "lon")
    more = linenet.add_lines(linenet.LineNetwork(places.withColumn("name", F.lit("")), net.segments, net.succ, net.window_s), linenet.line_sections(stations, places))
    own = more.segments.filter("seg like 'NEW%'").join(more.succ.select("seg", "next"), "seg", "left")
    return own.select("seg", "mode", "from_hub", "to_hub", F.col("n").cast("long").alias("n"), R("freq", 9), R("tau_s", 5), R("dist_m", 3), "next")


@Q.add(f"WITH {NET}, hf AS (SELECT i AS hub, sum(freq) AS freq FROM sg0 GROUP BY i), nm AS (SELECT n_nationkey AS hub, 'R' || n_regionkey AS name FROM nation WHERE n_nationkey IN (SELECT i FROM lp UNION SELECT j FROM lp)) SELECT w.name, x.hub FROM (SELECT DISTINCT 'R' || n_regionkey AS name FROM nation UNION ALL SELECT 'nowhere') w LEFT JOIN (SELECT name, arg_min(hub, -coalesce(freq, 0.0) * 1e6 + hub * 1e-9) AS hub FROM nm LEFT JOIN hf USING (hub) GROUP BY name) x USING (name)")
def hubs_named(spark, sf_dir):
    """The busiest nation of each region, regions being names that several hubs have."""
    net = line_network(spark, sf_dir)
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("hub"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("name"))
    own = linenet.LineNetwork(net.hubs.drop("name").join(regions, "hub"), net.segments, net.succ, net.window_s)
    return linenet.hubs_named(own, regions.select("name").unionByName(spark.range(1).select(F.lit("nowhere").alias("name"))))


@Q.add("SELECT n_regionkey, arg_min(n_nationkey, rank) AS station FROM (SELECT n_regionkey, n_nationkey, CASE WHEN n_name = 'CHINA' THEN 0 WHEN starts_with(n_name, 'C') THEN 1 ELSE 2 END * 100 + n_nationkey AS rank FROM nation) GROUP BY n_regionkey")
def station_lookup(spark, sf_dir):
    rank = F.when(F.col("n_name") == "CHINA", 0).when(F.col("n_name").startswith("C"), 1).otherwise(2) * 100 + F.col("n_nationkey")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min_by("n_nationkey", rank).alias("station"))


EVENT_PEOPLE = f"WITH {t.EV}, n AS (SELECT count(DISTINCT stop) AS k FROM ev)"


def people(spark, sf_dir):
    return event_rates(spark, sf_dir).select("mode", F.col("i").alias("node"), F.lit(40.0).alias("n"))


@Q.add(f"{EVENT_PEOPLE} SELECT unnest(range(8)) AS run, k * 40 AS total FROM n")
def ssa_conservation(spark, sf_dir):
    q = chain.generator(event_chain(spark, sf_dir), event_rates(spark, sf_dir))
    return simulate.event_ensemble(q, people(spark, sf_dir), 0.5, runs=8, most=None).groupBy("run").agg(F.sum("n").alias("total"))


@Q.add(f"{EVENT_PEOPLE} SELECT run, CAST(point * 0.25 AS DOUBLE) AS t, k * 40 AS total FROM n, (SELECT unnest(range(6)) AS run), (SELECT unnest(range(3)) AS point)")
def leap_conservation(spark, sf_dir):
    q = chain.generator(event_chain(spark, sf_dir), event_rates(spark, sf_dir))
    return simulate.leap_ensemble(q, people(spark, sf_dir), 0.5, runs=6, points=3).groupBy("run", "t").agg(F.sum("n").alias("total"))


LAW = f"WITH RECURSIVE {EQ}, r AS (SELECT max(-q) AS rate FROM eq WHERE i = j), j AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END + q / rate AS p FROM eq, r), x AS (SELECT node, 40.0::DOUBLE AS v, 0 AS k, exp(-rate * 0.5) AS w FROM (SELECT DISTINCT stop AS node FROM ev), r UNION ALL SELECT j.j, sum(x.v * j.p), x.k + 1, max(x.w * rate * 0.5 / (x.k + 1)) FROM x JOIN j ON x.node = j.i, r WHERE x.k < 300 GROUP BY j.j, x.k + 1)"


@Q.add(f"{LAW} SELECT node, round(sum(w * v), 6) AS expected, true AS close FROM x GROUP BY node")
def ssa_against_law(spark, sf_dir):
    """The transient law, and whether the mean of 20 exact runs is within five standard errors of it."""
    q = chain.generator(event_chain(spark, sf_dir), event_rates(spark, sf_dir))
    start = people(spark, sf_dir)
    law = chain.transient(q, start.select("mode", "node", F.col("n").alias("v")), 0.5)
    own = simulate.against_mean(simulate.event_ensemble(q, start, 0.5, runs=20, most=None), law)
    return own.select("node", R("expected", 6), (F.abs("z") < 5).alias("close"))


@Q.add(f"{EVENT_PEOPLE} SELECT stop AS node, 2 AS run, true AS balanced, true AS ordered FROM (SELECT DISTINCT stop FROM ev)")
def event_log(spark, sf_dir):
    """Each event of a run moves one person: the people at the end are those at the start, what came and without what went; times go up."""
    q = cut(chain.generator(event_chain(spark, sf_dir), event_rates(spark, sf_dir)))
    start = cut(people(spark, sf_dir))
    log = cut(simulate.event_log(q, start, 0.2, runs=3, most=None).filter("run = 2"))
    end = simulate.event_ensemble(q, start, 0.2, runs=3, most=None).filter("run = 2").select("node", F.col("n").alias("last"))
    moves = log.select(F.col("node"), F.lit(-1).alias("x")).unionByName(log.select(F.col("to_node").alias("node"), F.lit(1).alias("x"))).groupBy("node").agg(F.sum("x").alias("x"))
    ordered = log.select((F.col("t") >= F.lag("t", 1, 0.0).over(Window.partitionBy("run").orderBy("k"))).alias("ok")).agg(F.min("ok").alias("ordered"))
    return start.join(end, "node").join(moves, "node", "left").crossJoin(ordered).select("node", F.lit(2).alias("run"), (F.col("n") + F.coalesce("x", F.lit(0)) == F.col("last")).alias("balanced"), "ordered")


@Q.add(f"WITH RECURSIVE {NET}{SOURCE} SELECT CAST(20000 AS BIGINT) AS passengers, round(sum(mass) / 10.0, 4) AS seconds, true AS close FROM ma")
def journey_simulation(spark, sf_dir):
    """Simulated passengers, the exact mean of their time, and whether the simulated mean is within four standard errors of it."""
    model = linenet.OpenModel(line_network(spark, sf_dir))
    own = model.journeys(model.prior(), 20_000).agg(F.count(F.lit(1)).alias("passengers"), F.avg("seconds").alias("mean"), (F.stddev("seconds") / F.sqrt(F.count(F.lit(1)))).alias("error"))
    exact = model.journey_time(source(model))
    return own.crossJoin(exact).select("passengers", R("seconds", 4), (F.abs(F.col("mean") - F.col("seconds")) < 4 * F.col("error")).alias("close"))


@Q.add(f"WITH {NET}, p AS (SELECT i, md, q / sum(q) OVER (PARTITION BY i) AS p, theta / sum(theta) OVER (PARTITION BY i) AS p0 FROM m3), h AS (SELECT i, sum(abs(p - p0)) / 2 AS tv, count(*) AS n, count(DISTINCT md) AS k FROM p GROUP BY i) SELECT round(avg(tv), 9) AS variation, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 9) AS several_segments, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END), 9) AS several_routes, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END), 9) AS several_modes FROM h")
def choice_diagnostics(spark, sf_dir):
    own = layers.choice_diagnostics(linenet.OpenModel(line_network(spark, sf_dir)).segments)
    return own.select(*(R(c, 9) for c in own.columns))


@Q.add(f"WITH {t.HC}, {t.NP}, ly AS (SELECT a.n_regionkey * 5 AS i, b.n_regionkey * 5 AS j, median(cost) AS cost FROM hc JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2) SELECT i, j, round(cost, 6) AS cost, round({t.haversine_sql('p', 'q')}, 3) AS m FROM ly JOIN np p ON p.node = i JOIN np q ON q.node = j")
def planning_layer(spark, sf_dir):
    """Regions as areas; each stands at one of its places by formula."""
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stop"), (F.col("n_regionkey") * 5).alias("area"))
    own = layers.layer_edges(t.hub_costs(spark, sf_dir), areas, t.nation_points(spark, sf_dir))
    return own.select("i", "j", R("cost", 6), R("m", 3))


AREA_STOPS = "sp AS (SELECT s_suppkey AS stop, s_nationkey AS name, 47.4::DOUBLE + s_nationkey * 0.01::DOUBLE + s_suppkey * 37 % 100 * 0.0001::DOUBLE AS lat, 19.0::DOUBLE + s_suppkey * 53 % 100 * 0.0001::DOUBLE AS lon FROM supplier)"


@Q.add(f"WITH RECURSIVE {AREA_STOPS}, s AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stop) AS k FROM sp), r AS (SELECT name, k, stop, stop AS area, [struct_pack(s := stop, a := lat, b := lon)] AS heads FROM s WHERE k = 1 UNION ALL SELECT name, k, stop, coalesce(f, stop), CASE WHEN f IS NULL THEN list_append(heads, struct_pack(s := stop, a := lat, b := lon)) ELSE heads END FROM (SELECT s.*, r.heads, list_filter(r.heads, lambda h: {t.HAVERSINE.format(lat1='h.a', lon1='h.b', lat2='s.lat', lon2='s.lon')} < 400)[1].s AS f FROM r JOIN s ON s.name = r.name AND s.k = r.k + 1)) SELECT stop, area FROM r")
def merged_areas(spark, sf_dir):
    """Suppliers of a nation as stops of one name, merged in order."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    stops = table(spark, sf_dir, "supplier").select(k.alias("stop"), F.concat(F.lit("N"), n, F.lit(" (x)")).alias("name"), (F.lit(47.4) + n * 0.01 + k * 37 % 100 * 0.0001).alias("lat"), (F.lit(19.0) + k * 53 % 100 * 0.0001).alias("lon"))
    return layers.merge_areas(stops)

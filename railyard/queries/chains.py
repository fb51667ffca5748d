"""Queries: Markov chains and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.fixpoint import cut
from railyard.operators import graph
from railyard.plans import chain, stationary
from railyard.queries import tables as t
from railyard.registry import Registry

Q = Registry()
R = lambda c, n=8: F.round(c, n).alias(c)

# the event graph with a cost in hours; 1/24 a hour is the sensitivity
EK = t.EE + ", ew AS (SELECT mode, i, j, exp(-(tau_s - min(tau_s) OVER (PARTITION BY mode, i)) / 24.0) AS w, n, tau_s FROM ee), ek AS (SELECT mode, i, j, w / sum(w) OVER (PARTITION BY mode, i) AS p FROM ew)"
EM = ", em AS (SELECT mode, stop AS i, count(DISTINCT trip) / 24.0 AS mu FROM ev GROUP BY mode, stop)"
EQ = EK + EM + ", eo AS (SELECT mode, i, j, mu * p AS q FROM ek JOIN em USING (mode, i) WHERE i <> j), eq AS (SELECT * FROM eo UNION ALL SELECT mode, i, i, -sum(q) FROM eo GROUP BY mode, i)"
SG = t.SG


def event_chain(spark, sf_dir):
    return chain.kernel(t.event_edges(spark, sf_dir), 1 / 24, "tau_s")


def event_rates(spark, sf_dir):
    return t.event_visits(spark, sf_dir).groupBy("mode", F.col("stop").alias("i")).agg((F.countDistinct("trip") / 24.0).alias("mu"))


@Q.add(f"WITH {EK} SELECT i, j, n, round(tau_s, 8) AS tau_s, round(p, 8) AS p FROM ek JOIN ee USING (mode, i, j)")
def softmax_kernel(spark, sf_dir):
    edges = t.event_edges(spark, sf_dir)
    return chain.kernel(edges, 1 / 24, "tau_s").join(edges, ["mode", "i", "j"]).select("i", "j", "n", R("tau_s"), R("p"))


@Q.add(f"WITH {EQ} SELECT i, j, round(q, 8) AS q FROM eq")
def generator_rows(spark, sf_dir):
    return chain.generator(event_chain(spark, sf_dir), event_rates(spark, sf_dir)).select("i", "j", R("q"))


@Q.add(f"WITH {EQ}, a AS (SELECT mode, i, sum(q) AS s, count(*) AS k FROM eq GROUP BY mode, i), b AS (SELECT mode, i, sum(p) AS s FROM ek GROUP BY mode, i) SELECT mode, CAST(sum(k) AS BIGINT) AS stored, max(abs(s)) < 1e-8 AS rows_ok, (SELECT max(abs(s - 1)) < 1e-8 FROM b) AS kernel_ok, (SELECT round(min(q), 8) FROM eq WHERE i <> j) AS least_rate, 0 AS absorbing FROM a GROUP BY mode")
def generator_validate(spark, sf_dir):
    own = event_chain(spark, sf_dir)
    return chain.validate(chain.generator(own, event_rates(spark, sf_dir)), own).select("mode", "stored", (F.col("row_error") < 1e-8).alias("rows_ok"), (F.col("kernel_error") < 1e-8).alias("kernel_ok"), R("least_rate"), F.col("absorbing").cast("int").alias("absorbing"))


LAMS = [round(0.001 * 1.5**k, 6) for k in range(25)]


@Q.add(f"WITH {t.EE}, l AS (SELECT unnest({LAMS}::DOUBLE[]) AS lam), w AS (SELECT lam, i, exp(-lam * (tau_s - min(tau_s) OVER (PARTITION BY lam, i))) AS w FROM ee, l), p AS (SELECT lam, i, w / sum(w) OVER (PARTITION BY lam, i) AS p FROM w), h AS (SELECT lam, i, sum(CASE WHEN p > 0 THEN -p * ln(p) END) AS h FROM p GROUP BY lam, i) SELECT lam, round(avg(h), 8) AS entropy FROM h GROUP BY lam")
def row_entropy_lambda_sweep(spark, sf_dir):
    edges = t.event_edges(spark, sf_dir).withColumnRenamed("tau_s", "cost")
    return chain.entropy_sweep(edges, LAMS).select("lam", R("entropy"))


def limit_sql(doublings: int = 34) -> str:
    """m: the limit of the mean of the powers of ek, the mean over twice as many powers by one product; rows are kept at 1."""
    out = ", nn AS (SELECT mode, i AS node FROM ek UNION SELECT mode, j FROM ek), p0 AS (SELECT mode, i, j, p FROM ek UNION ALL SELECT mode, node, node, 1.0 FROM nn WHERE (mode, node) NOT IN (SELECT mode, i FROM ek)), m0 AS (SELECT mode, node AS i, node AS j, 1.0::DOUBLE AS p FROM nn)"
    for k in range(doublings):
        out += f", p{k + 1} AS MATERIALIZED (SELECT mode, i, j, s / sum(s) OVER (PARTITION BY mode, i) AS p FROM (SELECT mode, a.i, b.j, sum(a.p * b.p) AS s FROM p{k} a JOIN (SELECT mode, i AS c, j, p FROM p{k}) b USING (mode) WHERE a.j = b.c GROUP BY mode, a.i, b.j))"
        out += f", m{k + 1} AS MATERIALIZED (SELECT mode, i, j, sum(s) / sum(sum(s)) OVER (PARTITION BY mode, i) AS p FROM (SELECT mode, i, j, p AS s FROM m{k} UNION ALL SELECT mode, a.i, b.j, sum(a.p * b.p) FROM p{k} a JOIN (SELECT mode, i AS c, j, p FROM m{k}) b USING (mode) WHERE a.j = b.c GROUP BY mode, a.i, b.j) GROUP BY mode, i, j)"
    return out + f", pi AS (SELECT mode, j AS node, sum(p) / (SELECT count(*) FROM nn x WHERE x.mode = m{doublings}.mode) AS pi FROM m{doublings} GROUP BY mode, j)"


LIMIT = EK + limit_sql()


@Q.add(f"WITH {LIMIT} SELECT node, round(pi, 8) AS pi FROM pi")
def stationary_cesaro(spark, sf_dir):
    return stationary.limit(event_chain(spark, sf_dir)).select("node", R("pi"))


@Q.add(f"WITH {LIMIT}{EM} SELECT node, round(pi / sum(pi / mu) OVER (), 8) AS flux FROM pi JOIN em ON node = em.i")
def departure_flux(spark, sf_dir):
    return chain.departure_flux(stationary.limit(event_chain(spark, sf_dir)), event_rates(spark, sf_dir)).select("node", R("flux"))


@Q.add(f"WITH {t.LV}, served AS (SELECT DISTINCT mode, stop FROM lv), pop AS (SELECT c_nationkey, sum(c_acctbal) AS n FROM customer GROUP BY c_nationkey) SELECT mode, stop AS node, round(coalesce(n, 0) / count(*) OVER (PARTITION BY stop), 6) AS n FROM served LEFT JOIN pop ON c_nationkey = stop")
def modal_allocation(spark, sf_dir):
    from railyard.registry import table

    served = t.line_visits(spark, sf_dir).select("mode", F.col("stop").alias("node")).distinct()
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.sum("c_acctbal").alias("n"))
    return chain.allocate(people, served).select("mode", "node", R("n", 6))


@Q.add(f"WITH RECURSIVE {EQ}, r AS (SELECT max(-q) AS rate FROM eq WHERE i = j), j AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END + q / rate AS p FROM eq, r), s AS (SELECT i AS node, 100.0::DOUBLE * (row_number() OVER (ORDER BY i)) AS v FROM (SELECT DISTINCT i FROM ek)), x AS (SELECT node, v, 0 AS k, exp(-rate * 0.5) AS w FROM s, r UNION ALL SELECT j.j, sum(x.v * j.p), x.k + 1, max(x.w * rate * 0.5 / (x.k + 1)) FROM x JOIN j ON x.node = j.i, r WHERE x.k < 300 GROUP BY j.j, x.k + 1), u AS (SELECT sum(w) AS used FROM (SELECT DISTINCT k, w FROM x)) SELECT node, round(sum(w * v) / (SELECT used FROM u), 6) AS n FROM x GROUP BY node")
def transient_law(spark, sf_dir):
    own = cut(event_chain(spark, sf_dir))
    names = chain.nodes_of(own).select("mode", "node", (100.0 * F.row_number().over(Window.partitionBy("mode").orderBy("node"))).alias("v"))
    return chain.transient(chain.generator(own, event_rates(spark, sf_dir)), names, 0.5).select("node", R("n", 6))


@Q.add(f"WITH {t.EV}{EM} SELECT least(1.0, round(0.03 / max(mu), 12)) AS leap FROM em WHERE i <> 'none'")
def leap_size(spark, sf_dir):
    rates = event_rates(spark, sf_dir)
    state = rates.select("mode", F.col("i").alias("node"), F.lit(5.0).alias("n"))
    return chain.largest_leap(state, rates, 1.0, 0.03).select(F.round("leap", 12).alias("leap"))


@Q.add(f"WITH {EK}, n AS (SELECT DISTINCT i AS removed FROM ek), g AS (SELECT removed, i, j, p FROM ek, n WHERE i <> removed AND j <> removed) SELECT removed, i, j, round(p / sum(p) OVER (PARTITION BY removed, i), 8) AS p FROM g")
def node_removal(spark, sf_dir):
    own = event_chain(spark, sf_dir)
    return graph.remove_node(own, own.select(F.col("i").alias("removed")).distinct()).select("removed", "i", "j", R("p"))


BFS = SG + ", b AS (SELECT DISTINCT i AS source, i AS node, 0 AS d FROM sg UNION SELECT b.source, sg.j, b.d + 1 FROM b JOIN sg ON b.node = sg.i WHERE b.d < 24), h AS (SELECT source, node, min(d) AS d FROM b GROUP BY source, node)"


@Q.add(f"WITH RECURSIVE {BFS} SELECT source, node, d FROM h")
def bfs_hops(spark, sf_dir, links=t.hub_graph):
    return graph.hops(links(spark, sf_dir))


@Q.add(f"WITH RECURSIVE {BFS}, n AS (SELECT count(*) AS n FROM (SELECT i FROM sg UNION SELECT j FROM sg)) SELECT round(sum(1.0 / d) / max(n * (n - 1)), 9) AS efficiency FROM h, n WHERE d > 0")
def bfs_efficiency(spark, sf_dir, links=t.hub_graph):
    edges = links(spark, sf_dir)
    n = edges.select("i").union(edges.select("j")).distinct().count()
    return graph.efficiency(graph.hops(edges), n).select(R("efficiency", 9))


@Q.add(f"WITH RECURSIVE {SG}, b AS (SELECT i AS a, i AS z FROM sg UNION SELECT j, j FROM sg UNION SELECT b.a, e.z FROM b JOIN (SELECT i AS y, j AS z FROM sg UNION SELECT j, i FROM sg) e ON b.z = e.y) SELECT a AS node, min(z) AS label FROM b GROUP BY a")
def connected_components(spark, sf_dir, links=t.hub_graph):
    return graph.components(links(spark, sf_dir))


@Q.add(f"WITH RECURSIVE {SG}, b AS (SELECT i AS a, i AS z FROM sg UNION SELECT j, j FROM sg UNION SELECT b.a, sg.j FROM b JOIN sg ON b.z = sg.i) SELECT x.a AS node, min(x.z) AS label FROM b x JOIN b y ON x.a = y.z AND x.z = y.a GROUP BY x.a")
def strong_components(spark, sf_dir, links=t.hub_graph):
    return graph.strong_components(links(spark, sf_dir))


WALK = ", w AS (SELECT DISTINCT i AS source, i AS node, 0.0::DOUBLE AS t, 0 AS k FROM (SELECT i FROM sg UNION SELECT j FROM sg) UNION ALL SELECT w.source, sg.j, min(w.t + sg.cost), w.k + 1 FROM w JOIN sg ON w.node = sg.i WHERE w.k < 24 GROUP BY w.source, sg.j, w.k + 1), sp AS (SELECT source, node, min(t) AS t FROM w GROUP BY source, node)"
SP = SG + WALK


@Q.add(f"WITH RECURSIVE {SP} SELECT source, node, round(t, 6) AS t FROM sp")
def shortest_times(spark, sf_dir, links=t.hub_graph):
    return graph.shortest(links(spark, sf_dir)).select("source", "node", R("t", 6))


@Q.add(f"WITH RECURSIVE {SG}, c AS (SELECT DISTINCT i AS source, i AS node, 0 AS d, 1.0::DOUBLE AS n FROM sg UNION ALL SELECT c.source, sg.j, c.d + 1, sum(c.n) FROM c JOIN sg ON c.node = sg.i WHERE c.d < 24 GROUP BY c.source, sg.j, c.d + 1), s AS (SELECT source, node, min(d) AS d, arg_min(n, d) AS n FROM c GROUP BY source, node), k AS (SELECT count(*) AS k FROM (SELECT i FROM sg UNION SELECT j FROM sg)), v AS (SELECT x.node, sum(x.n * y.n / z.n) AS b FROM s x JOIN s y ON x.node = y.source JOIN s z ON z.source = x.source AND z.node = y.node AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 AND z.d > 0 GROUP BY x.node) SELECT a.node, round(coalesce(b, 0.0) / ((k - 1) * (k - 2)), 8) AS b FROM (SELECT i AS node FROM sg UNION SELECT j FROM sg) a LEFT JOIN v USING (node), k")
def betweenness(spark, sf_dir, links=t.hub_graph):
    return graph.betweenness(links(spark, sf_dir)).select("node", R("b"))


@Q.add(f"WITH RECURSIVE {SG}, n AS (SELECT i AS node FROM sg UNION SELECT j FROM sg), b AS (SELECT r.node AS removed, n.node AS a, n.node AS z FROM n, n r WHERE n.node <> r.node UNION SELECT b.removed, b.a, sg.j FROM b JOIN sg ON b.z = sg.i WHERE sg.j <> b.removed) SELECT removed AS node, count(*) < ((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 1) AS breaks FROM b GROUP BY removed")
def breaking_nodes(spark, sf_dir, links=t.hub_graph):
    return graph.breaking_nodes(links(spark, sf_dir))


def kemeny_sql(chain_table: str, keys: str, doublings: int = 11) -> str:
    """k: trace of the sum of 2^doublings powers, less their number: the Kemeny constant of chains that mix by then."""
    on = f"USING ({keys})"
    out = f", q0 AS (SELECT {keys}, i, j, p FROM {chain_table}), z0 AS (SELECT DISTINCT {keys}, i, i AS j, 1.0::DOUBLE AS p FROM {chain_table})"
    for k in range(doublings):
        product = lambda x, k=k: f"SELECT {keys}, a.i, b.j, sum(a.p * b.p) AS p FROM q{k} a JOIN (SELECT {keys}, i AS c, j, p FROM {x}{k}) b {on} WHERE a.j = b.c GROUP BY {keys}, a.i, b.j"
        out += f", z{k + 1} AS MATERIALIZED (SELECT {keys}, i, j, sum(p) AS p FROM (SELECT {keys}, i, j, p FROM z{k} UNION ALL {product('z')}) GROUP BY {keys}, i, j), q{k + 1} AS MATERIALIZED ({product('q')})"
    return out + f", km AS (SELECT {keys}, sum(p) - {2**doublings} AS kemeny FROM z{doublings} WHERE i = j GROUP BY {keys})"


DIAGNOSED = t.LE + ", ew AS (SELECT mode, i, j, exp(-(tau_s - min(tau_s) OVER (PARTITION BY mode, i)) / 24.0) AS w FROM le), ek AS (SELECT mode, i, j, w / sum(w) OVER (PARTITION BY mode, i) AS p FROM ew WHERE w > 0)" + kemeny_sql("ek", "mode")
MODE_HOPS = ", hb AS (SELECT DISTINCT mode, i AS source, i AS node, 0 AS d FROM ek UNION SELECT hb.mode, hb.source, ek.j, hb.d + 1 FROM hb JOIN ek ON hb.mode = ek.mode AND hb.node = ek.i WHERE hb.d < 12), hm AS (SELECT mode, source, node, min(d) AS d FROM hb GROUP BY mode, source, node), hn AS (SELECT mode, count(DISTINCT source) AS n FROM hm GROUP BY mode)"


@Q.add(f"WITH RECURSIVE {DIAGNOSED}{MODE_HOPS} SELECT mode, max(n) AS nodes, round(max(kemeny), 5) AS kemeny, round(sum(CASE WHEN d > 0 THEN 1.0 / d END) / (max(n) * (max(n) - 1)), 9) AS efficiency, count(*) = max(n) * max(n) AS irreducible, false AS periodic FROM hm JOIN hn USING (mode) JOIN km USING (mode) GROUP BY mode")
def chain_diagnostics(spark, sf_dir):
    """Kemeny constant, efficiency and whether irreducible or periodic, of each mode's hub chain."""
    edges = t.line_edges(spark, sf_dir).withColumn("cost", F.col("tau_s"))
    return chain.diagnostics(chain.kernel(edges, 1 / 24)).select("mode", "nodes", R("kemeny", 5), R("efficiency", 9), "irreducible", "periodic")


REMOVED = EK + ", rn AS (SELECT DISTINCT i AS removed FROM ek), ra AS (SELECT removed, i, j, p FROM ek, rn WHERE i <> removed AND j <> removed), rk AS (SELECT removed, i, j, p / sum(p) OVER (PARTITION BY removed, i) AS p FROM ra UNION ALL SELECT removed, node, node, 1.0 FROM (SELECT DISTINCT removed, i AS node FROM ek, rn WHERE i <> removed) WHERE (removed, node) NOT IN (SELECT removed, i FROM ra)), rw AS (SELECT 'whole' AS removed, i, j, p FROM ek UNION ALL SELECT * FROM rk)"


@Q.add(f"WITH {REMOVED}{kemeny_sql('rw', 'removed')}, k0 AS (SELECT kemeny AS k FROM km WHERE removed = 'whole') SELECT removed AS node, round(greatest(0.0, (kemeny - k) / k), 5) AS d_kemeny FROM km, k0 WHERE removed <> 'whole'")
def removal_kemeny(spark, sf_dir):
    """What the Kemeny constant of the event chain loses without each event type (a chain that stays irreducible)."""
    return chain.removals(event_chain(spark, sf_dir)).select("node", R("d_kemeny", 5))


@Q.add()
def removal_scores(spark, sf_dir):
    """Vulnerability of each event type of the event chain, with the losses of gap and efficiency."""
    return chain.removals(event_chain(spark, sf_dir))


def gap_sql(squarings: int = 20, doublings: int = 30) -> str:
    """gp: 1 less the second modulus of each mode's hub chain lk. Rows of a high power are the law pi; without them (d = p - pi), norms of powers grow by that modulus. Powers are squared and kept at a largest entry of 1, whose logarithm is carried in s."""
    out = t.LE + ", lw AS (SELECT mode, i, j, exp(-(tau_s - min(tau_s) OVER (PARTITION BY mode, i)) / 24) AS w FROM le), lk AS MATERIALIZED (SELECT mode, i, j, w / sum(w) OVER (PARTITION BY mode, i) AS p FROM lw), ln AS (SELECT mode, i AS node FROM lk UNION SELECT mode, j FROM lk), q0 AS (SELECT * FROM lk)"
    for k in range(squarings):
        out += f", q{k + 1} AS MATERIALIZED (SELECT mode, i, j, s / sum(s) OVER (PARTITION BY mode, i) AS p FROM (SELECT a.mode, a.i, b.j, sum(a.p * b.p) AS s FROM q{k} a JOIN q{k} b ON a.mode = b.mode AND a.j = b.i GROUP BY a.mode, a.i, b.j))"
    out += f", lp2 AS (SELECT mode, j, avg(p) AS pi FROM q{squarings} GROUP BY mode, j), d0 AS MATERIALIZED (SELECT a.mode, a.node AS i, b.node AS j, coalesce(p, 0) - coalesce(pi, 0) AS x, 0.0::DOUBLE AS s FROM ln a JOIN ln b ON a.mode = b.mode LEFT JOIN lk ON lk.mode = a.mode AND lk.i = a.node AND lk.j = b.node LEFT JOIN lp2 ON lp2.mode = b.mode AND lp2.j = b.node)"
    for k in range(doublings):
        out += f", d{k + 1} AS MATERIALIZED (SELECT mode, i, j, x / c AS x, 2 * s + ln(c) AS s FROM (SELECT *, max(abs(x)) OVER (PARTITION BY mode) AS c FROM (SELECT a.mode, a.i, b.j, sum(a.x * b.x) AS x, max(a.s) AS s FROM d{k} a JOIN d{k} b ON a.mode = b.mode AND a.j = b.i GROUP BY a.mode, a.i, b.j)))"
    return out + f", gp AS (SELECT mode, 1 - exp(max(s) / {2**doublings}.0::DOUBLE) AS gap FROM d{doublings} GROUP BY mode)"


@Q.add(f"WITH {gap_sql()} SELECT mode, round(gap, 7) AS gap FROM gp")
def chain_gaps(spark, sf_dir):
    """Spectral gap of each mode's hub chain."""
    edges = t.line_edges(spark, sf_dir).withColumn("cost", F.col("tau_s"))
    return chain.diagnostics(chain.kernel(edges, 1 / 24)).select("mode", R("gap", 7))


GRID = [0.25, 0.5, 1.0]


@Q.add(" UNION ALL ".join(["SELECT * FROM (WITH RECURSIVE " + EQ + f", r AS (SELECT max(-q) AS rate FROM eq WHERE i = j), j AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END + q / rate AS p FROM eq, r), s AS (SELECT i AS node, 100.0::DOUBLE * (row_number() OVER (ORDER BY i)) AS v FROM (SELECT DISTINCT i FROM ek)), x AS (SELECT node, v, 0 AS k, exp(-rate * {x}) AS w FROM s, r UNION ALL SELECT j.j, sum(x.v * j.p), x.k + 1, max(x.w * rate * {x} / (x.k + 1)) FROM x JOIN j ON x.node = j.i, r WHERE x.k < 300 GROUP BY j.j, x.k + 1) SELECT {x}::DOUBLE AS t, node, round(sum(w * v), 6) AS n FROM x GROUP BY node)" for x in GRID]))
def transient_grid(spark, sf_dir):
    """The law of the event chain at several times, each going on from the one before."""
    own = cut(event_chain(spark, sf_dir))
    names = chain.nodes_of(own).select("mode", "node", (100.0 * F.row_number().over(Window.partitionBy("mode").orderBy("node"))).alias("v"))
    return chain.transient_grid(chain.generator(own, event_rates(spark, sf_dir)), names, GRID).select("t", "node", R("n", 6))

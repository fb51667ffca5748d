"""Queries: lines on the street grid, between nations that stand at its nodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.fixpoint import cut
from railyard.plans import layers
from railyard.queries.demand import GRID, street_graph
from railyard.registry import Registry, table

Q = Registry()
R = lambda c, n=6: F.round(c, n).alias(c)

#: Metres that a line's stations are apart, lengths of lines, and how far from its way a station may be.
SPACING, LEAST, MOST, RADIUS, DETOUR = 190.0, 300.0, 900.0, 155.5, 1.6

WAYS = GRID + """, sx AS (SELECT ua * 100 + ub AS i, va * 100 + vb AS j, length AS cost FROM ge UNION ALL SELECT va * 100 + vb, ua * 100 + ub, length FROM ge),
hb AS (SELECT n_nationkey AS hub, n_regionkey AS region, n_nationkey * 3 % 10 * 100 + n_nationkey * 7 % 10 AS node, (n_nationkey * 3 % 10 + 0.5) * 100.0::DOUBLE + n_nationkey % 5 * 9 - 18 AS x, (n_nationkey * 7 % 10 + 0.5) * 100.0::DOUBLE + n_nationkey % 3 * 11 - 9 AS y, coalesce(w, 0.0)::DOUBLE AS weight FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS w FROM customer GROUP BY c_nationkey) ON c_nationkey = n_nationkey),
wk AS (SELECT DISTINCT node AS s, node, 0.0::DOUBLE AS t, 0 AS h FROM hb UNION ALL SELECT s, j, min(t + cost), h + 1 FROM wk JOIN sx ON wk.node = sx.i WHERE h < 40 GROUP BY s, j, h + 1),
sd AS MATERIALIZED (SELECT s, node, min(t) AS t FROM wk GROUP BY s, node)"""


def streets(spark, sf_dir):
    """(i, j, cost) both ways; a node's number is 100 times its column and its row."""
    number = lambda end: (F.col(f"{end}.a") * 100 + F.col(f"{end}.b")).cast("long")
    one = street_graph(spark, sf_dir).select(number("u").alias("i"), number("v").alias("j"), F.col("length").alias("cost"))
    return cut(one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "cost")))


def hubs(spark, sf_dir):
    """(hub, region, node, x, y, weight)"""
    n = F.col("n_nationkey")
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    own = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left")
    at = lambda k: (n * k % 10 + 0.5) * 100.0
    return own.select(n.alias("hub"), F.col("n_regionkey").alias("region"), (n * 3 % 10 * 100 + n * 7 % 10).cast("long").alias("node"), (at(3) + n % 5 * 9 - 18).alias("x"), (at(7) + n % 3 * 11 - 9).alias("y"), F.coalesce("w", F.lit(0.0)).alias("weight"))


@Q.add(f"WITH RECURSIVE {WAYS}, sn AS (SELECT region, hub, node, row_number() OVER w AS k, lead(node) OVER w AS onward FROM hb WINDOW w AS (PARTITION BY region ORDER BY hub)) SELECT region AS line, k, hub, round(t, 6) AS next_m FROM sn LEFT JOIN sd ON s = sn.node AND sd.node = onward")
def routed_line(spark, sf_dir):
    """The metres on streets from each nation to the next one of its region."""
    own = hubs(spark, sf_dir)
    stations = own.select(F.col("region").alias("line"), F.lit("tram").alias("kind"), F.row_number().over(Window.partitionBy("region").orderBy("hub")).cast("long").alias("k"), "hub")
    return layers.routed_line(streets(spark, sf_dir), own.select("hub", "node"), stations).select("line", "k", "hub", R("next_m"))


LINES = WAYS + f""", pa AS (SELECT a.hub AS a, b.hub AS b, a.node AS na, b.node AS nb, t AS length FROM hb a JOIN hb b ON a.hub < b.hub JOIN sd ON sd.s = a.node AND sd.node = b.node WHERE t BETWEEN {LEAST} AND {MOST} AND t <= {DETOUR} * greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1.0)),
vi AS MATERIALIZED (SELECT x.s, y.node, min(sx.i) AS via FROM sd x JOIN sx ON sx.i = x.node JOIN sd y ON y.s = x.s AND y.node = sx.j AND y.t = x.t + sx.cost WHERE y.node <> y.s GROUP BY x.s, y.node),
bk AS (SELECT DISTINCT na AS s, nb AS target, nb AS node FROM pa UNION ALL SELECT bk.s, bk.target, vi.via FROM bk JOIN vi ON vi.s = bk.s AND vi.node = bk.node),
aw AS (SELECT bk.s, bk.target, sd.t AS along, (bk.node // 100 + 0.5) * 100.0::DOUBLE AS x, (bk.node % 100 + 0.5) * 100.0::DOUBLE AS y FROM bk JOIN sd ON sd.s = bk.s AND sd.node = bk.node),
nr AS (SELECT s, target, hub, weight, first(along ORDER BY dist, along) AS along FROM (SELECT aw.*, hub, weight, sqrt((aw.x - hb.x) ** 2 + (aw.y - hb.y) ** 2) AS dist FROM aw, hb) WHERE dist <= {RADIUS} GROUP BY s, target, hub, weight),
rn AS (SELECT a, b, hub, along, row_number() OVER (PARTITION BY a, b ORDER BY weight DESC, hub, along) AS k FROM pa JOIN nr ON s = na AND target = nb WHERE hub <> a AND hub <> b),
fo AS (SELECT a, b, 0 AS k, [struct_pack(along := 0.0::DOUBLE, hub := a), struct_pack(along := length, hub := b)] AS taken FROM pa UNION ALL SELECT fo.a, fo.b, fo.k + 1, CASE WHEN len(list_filter(fo.taken, lambda c: abs(n.along - c.along) < {SPACING})) = 0 THEN list_append(fo.taken, struct_pack(along := n.along, hub := n.hub)) ELSE fo.taken END FROM fo JOIN rn n ON n.a = fo.a AND n.b = fo.b AND n.k = fo.k + 1),
ta AS (SELECT a, b, arg_max(taken, k) AS taken FROM fo GROUP BY a, b)"""


@Q.add(f"WITH RECURSIVE {LINES} SELECT a, b, round(length, 6) AS length, array_to_string(list_transform(list_sort(taken), lambda c: c.hub), ',') AS hubs FROM pa JOIN ta USING (a, b)")
def street_lines(spark, sf_dir):
    """Lines on streets between all pairs of nations that are far enough apart, with the nations near their ways as stations."""
    own, ways = hubs(spark, sf_dir), streets(spark, sf_dir)
    node = F.col("node")
    nodes = ways.select(F.col("i").alias("node")).distinct().select("node", ((F.floor(node / 100) + 0.5) * 100.0).alias("x"), ((node % 100 + 0.5) * 100.0).alias("y"))
    pairs = own.select(F.col("hub").alias("a")).join(own.select(F.col("hub").alias("b")), F.col("a") < F.col("b"))
    found = layers.street_lines(ways, own.select("hub", "node"), pairs, nodes, own.select("hub", "x", "y", "weight"), SPACING, LEAST, MOST, RADIUS, DETOUR)
    return found.select("a", "b", R("length"), F.array_join(F.transform("stations", lambda s: s["hub"].cast("string")), ",").alias("hubs"))

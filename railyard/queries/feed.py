"""Queries: scanning, service days, predicates, names and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions import scalar
from railyard.operators import services
from railyard.queries import tables as t
from railyard.registry import Registry, table

Q = Registry()

DATE = "19960115"  # a Monday

# customers as services: a flag for each weekday by the bits of the key, valid for a year; orders as exceptions
CAL = """cal AS (SELECT CAST(c_custkey AS VARCHAR) AS service_id, """ + ", ".join(f"CAST((c_custkey >> {k}) & 1 AS INTEGER) AS {d}" for k, d in enumerate(scalar.WEEKDAYS)) + """,
  DATE '1995-01-01' + CAST(c_custkey % 500 AS INTEGER) AS start_date, DATE '1995-07-01' + CAST(c_custkey % 500 AS INTEGER) AS end_date FROM customer),
exc AS (SELECT CAST(o_custkey AS VARCHAR) AS service_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS exception_type FROM orders)"""


def calendar(spark, sf_dir):
    key = F.col("c_custkey")
    start = lambda first: F.date_format(F.date_add(F.to_date(F.lit(first)), (key % 500).cast("int")), "yyyyMMdd")
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("service_id"), *(F.shiftright(key, k).bitwiseAND(F.lit(1)).cast("string").alias(d) for k, d in enumerate(scalar.WEEKDAYS)), start("1995-01-01").alias("start_date"), start("1995-07-01").alias("end_date"))


def exceptions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.when(F.col("o_orderstatus") == "F", "2").otherwise("1").alias("exception_type"))


def order_trips(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").cast("string").alias("service_id"))


EXACT = f"(SELECT service_id FROM cal WHERE monday = 1 AND start_date <= DATE '1996-01-15' AND end_date >= DATE '1996-01-15' UNION SELECT service_id FROM exc WHERE date = DATE '1996-01-15' AND exception_type = 1) EXCEPT (SELECT service_id FROM exc WHERE date = DATE '1996-01-15' AND exception_type = 2)"
LOOSE = "SELECT service_id FROM cal WHERE monday = 1 UNION SELECT service_id FROM exc WHERE exception_type = 1 AND isodow(date) = 1"


@Q.add(f"WITH {CAL} {EXACT}")
def service_exact_date(spark, sf_dir):
    return services.on_date(calendar(spark, sf_dir), exceptions(spark, sf_dir), DATE)


@Q.add(f"WITH {CAL} {LOOSE}")
def service_weekday_union(spark, sf_dir):
    return services.on_weekday(calendar(spark, sf_dir), exceptions(spark, sf_dir), "monday")


@Q.add(f"WITH {CAL} SELECT DISTINCT service_id FROM exc WHERE exception_type = 1 AND isodow(date) = 6")
def service_exception_days(spark, sf_dir):
    return services.added_on_weekday(exceptions(spark, sf_dir), "saturday")


@Q.add(f"WITH {CAL}, act AS ({EXACT}), tr AS (SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT service_id FROM act)) SELECT l_orderkey AS trip_id, l_suppkey AS stop, l_linenumber AS seq FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM tr)")
def trip_semi_filter(spark, sf_dir):
    active = services.on_date(calendar(spark, sf_dir), exceptions(spark, sf_dir), DATE)
    visits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop"), F.col("l_linenumber").alias("seq"))
    return services.restrict(order_trips(spark, sf_dir), visits, active)[1]


@Q.add(f"WITH {CAL}, act AS ({EXACT}), loose AS ({LOOSE}), n AS (SELECT (SELECT count(*) FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT service_id FROM loose)) AS n_weekday, (SELECT count(*) FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT service_id FROM act)) AS n_date) SELECT n_weekday, n_date, round(n_weekday / nullif(n_date, 0), 9) AS ratio FROM n")
def calendar_inflation(spark, sf_dir):
    cal, exc = calendar(spark, sf_dir), exceptions(spark, sf_dir)
    return services.inflation(order_trips(spark, sf_dir), services.on_weekday(cal, exc, "monday"), services.on_date(cal, exc, DATE)).withColumn("ratio", F.round("ratio", 9))


@Q.add("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def removed_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(gone, "c_custkey", "left_anti")


TIME_SQL = "CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN '' ELSE ' ' || lpad(CAST(event_id % 31 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0') END"


@Q.add("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE CAST((event_id % 31) * 3600 + (event_id % 60) * 60 + event_id % 59 AS DOUBLE) END AS seconds FROM events")
def time_parse(spark, sf_dir):
    text = F.expr(TIME_SQL.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "events").select("event_id", scalar.seconds_of(text).alias("seconds"))


SUFFIX = "CASE p_partkey % 4 WHEN 0 THEN ' M+H' WHEN 1 THEN '  M' WHEN 2 THEN ' H' ELSE 'M' END"


@Q.add(f"SELECT p_partkey, regexp_replace(trim(p_name || {SUFFIX}), '\\s+(M\\+H|M|H)$', '') AS hub_name, trim(regexp_replace(p_name || ' (' || p_brand || ') x', '\\s*\\([^)]*\\)', '', 'g')) AS area FROM part")
def suffix_regex(spark, sf_dir):
    named = F.concat(F.col("p_name"), F.expr(SUFFIX))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.plain_stop_name(named).alias("hub_name"), scalar.area_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") x"))).alias("area"))


@Q.add("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 5 = 1 OR s_suppkey % 5 = 2 THEN CAST(s_suppkey AS VARCHAR) ELSE 'N' || CAST(s_nationkey AS VARCHAR) END AS station FROM supplier")
def parent_station(spark, sf_dir):
    parent = F.expr("CASE s_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE concat(' N', s_nationkey) END")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar.parent_or_self(F.col("s_suppkey"), parent).alias("station"))


@Q.add("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, try_cast(event_type AS DOUBLE) AS coerced, CAST(value AS DOUBLE) AS value FROM events")
def typed_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("double").alias("coerced"), F.col("value").cast("string").try_cast("double").alias("value"))


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@Q.add(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in NAMES))
def feed_summary(spark, sf_dir):
    counts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in NAMES]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


@Q.add(f"WITH {t.EV} SELECT stop, count(*) AS n FROM ev WHERE dep_s % 24 >= 7 AND dep_s % 24 < 9 AND stop IN ('click', 'view', 'purchase') GROUP BY stop")
def window_filter(spark, sf_dir):
    clock = F.col("dep_s") % 24
    return t.event_visits(spark, sf_dir).filter((clock >= 7) & (clock < 9) & F.col("stop").isin("click", "view", "purchase")).groupBy("stop").agg(F.count(F.lit(1)).alias("n"))


@Q.add("SELECT o_orderkey, coalesce(min_s, 0.0) AS transfer_s, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS stop_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, min(CASE WHEN s_acctbal < 0 THEN 120.0 ELSE floor(s_acctbal) END) AS min_s FROM supplier WHERE s_acctbal < 5000 GROUP BY s_nationkey) x ON x.s_nationkey = c_nationkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) y ON y.n_nationkey = c_nationkey")
def lookup_defaults(spark, sf_dir):
    from railyard.operators import edges

    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").select(F.col("s_nationkey").alias("from_stop"), F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal").cast("string")).alias("min_transfer_time"))
    least = edges.least_transfer(poor)
    named = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    base = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return base.join(least, F.col("from_stop") == F.col("c_nationkey"), "left").join(named, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", F.coalesce("transfer_s", F.lit(0.0)).alias("transfer_s"), F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("stop_name"))


@Q.add("SELECT 'overlap' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'difference', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    c, o, s = (table(spark, sf_dir, n) for n in ("customer", "orders", "supplier"))
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return size(c.select("c_nationkey").intersect(s.select("s_nationkey")), "overlap").union(size(o.select("o_custkey").union(c.select("c_custkey")).distinct(), "union")).union(size(c.select("c_custkey").subtract(o.select("o_custkey")), "difference"))

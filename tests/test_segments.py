import random

import pytest
from pyspark.sql import functions as F

from railyard.operators import edges, spatial
from railyard.plans import linenet


def test_stations_of_one_place_are_not_paired(spark, monkeypatch):
    """300 stations at one place were 44,850 pairs; now they are linked with the smallest one."""
    rows = [(f"s{k:03d}", "N", 47.5, 19.0) for k in range(300)] + [("a", "N", 47.5, 19.004), ("b", "N", 47.5, 19.008), ("c", "N", 47.6, 19.0), ("d", "M", 47.5, 19.0), ("e", "N", None, None), ("f", "N", None, None)]
    met = []
    real = spatial.same_name_near
    monkeypatch.setattr(spatial, "same_name_near", lambda stops, radius: met.append(stops.count()) or real(stops, radius))
    found = {r.station: r.hub for r in linenet.cluster_hubs(spark.createDataFrame(rows, "station string, name string, lat double, lon double")).collect()}
    assert met == [5]
    assert found == {f"s{k:03d}": "a" for k in range(300)} | {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f"}


def test_times_are_read_once(spark, monkeypatch):
    """The filter by the seconds had each text read a second time."""
    seen = []
    monkeypatch.setattr(linenet, "cut", lambda df: seen.append(df) or df)
    text = F.format_string("%02d:00:%02d", F.lit(7), F.col("id"))
    visits = spark.range(5).select(F.lit("t").alias("trip_id"), F.col("id").cast("string").alias("stop_id"), F.col("id").cast("string").alias("stop_sequence"), text.alias("arrival_time"), text.alias("departure_time"))
    linenet.departures(spark.createDataFrame([("r", "3")], "route_id string, route_type string"), spark.createDataFrame([("t", "r")], "trip_id string, route_id string"), visits)
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("format_string") <= 2
    assert sorted((r.i, r.j, r.dep_s) for r in seen[0].collect()) == [(str(k), str(k + 1), 25200.0 + k) for k in range(4)]


def test_segment_figures_are_those_made_apart(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 3), rng.randint(0, 5), float(rng.randint(0, 900)), rng.choice([None, *map(float, range(0, 90, 7))])) for _ in range(150)] + [("z", 0, 1, 5.0, None)]
    pairs = spark.createDataFrame(rows, "route string, i int, mode int, dep_s double, tau double")
    key = ["route", "i"]
    want = pairs.groupBy(*key).agg(F.min("mode").alias("mode"), F.count(F.lit(1)).alias("n"), F.median("tau").alias("tau_s")).join(edges.headway_irregularity(pairs, key).select(*key, "cv2"), key)
    order = lambda df: sorted(map(tuple, df.select(*key, "mode", "n", "tau_s", "cv2").collect()))
    for a, b in zip(order(edges.segment_figures(pairs, key)), order(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])

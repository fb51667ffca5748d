import pytest
from pyspark.sql import functions as F

from railyard.plans import chain, modal
from railyard.sources.feed import Feed


def clock(s):
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def bus_feed(spark, dist=True):
    visits = [(f"T{k}", s, n, clock(25200 + 1800 * k + 300 * n), clock(25200 + 1800 * k + 300 * n), 500.0 * n) for k in range(3) for n, s in enumerate("ABC")]
    frame = spark.createDataFrame(visits, "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string, shape_dist_traveled double")
    return Feed({
        "stops": spark.createDataFrame([("A", "A", 47.50, 19.05), ("B", "B", 47.51, 19.06), ("C", "C", 47.52, 19.07)], "stop_id string, stop_name string, stop_lat double, stop_lon double"),
        "routes": spark.createDataFrame([("R1", "3")], "route_id string, route_type string"),
        "trips": spark.createDataFrame([(f"T{k}", "R1", "WD") for k in range(3)], "trip_id string, route_id string, service_id string"),
        "stop_times": frame if dist else frame.drop("shape_dist_traveled"),
        "transfers": spark.createDataFrame([("B", "B", 2, 120)], "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int"),
    })


def test_bus(spark):
    net = modal.build(bus_feed(spark))
    rows = {(r.i, r.j): r for r in net.edges.collect()}
    assert set(rows) == {("A", "B"), ("B", "C")} and rows["B", "C"].transfer_s == 120
    assert rows["A", "B"].cost == pytest.approx(300 + 5) and rows["B", "C"].cost == pytest.approx(300 + 5 + 120)
    assert {r.stop: r.mu for r in net.nodes.collect()} == {s: pytest.approx(3 / 7200) for s in "ABC"}
    chain.assert_valid(net.generator(), net.chain())
    assert net.summary().first().nodes == 3
    far = modal.build(bus_feed(spark, dist=False)).edges.filter("i = 'A'").first()
    assert far.dist_m == pytest.approx(1341, rel=0.02)


def test_missing_coordinates(spark):
    own = bus_feed(spark, dist=False)
    own.tables["stops"] = own["stops"].withColumn("stop_lat", F.when(F.col("stop_id") != "B", F.col("stop_lat")))
    with pytest.raises(ValueError):
        modal.build(own)


def test_metro_platforms(spark):
    stops = [(f"{s}{d}", s, 47.5 + 0.01 * k, 19.0, s) for k, s in enumerate("ABC") for d in "01"] + [(s, s, 47.5 + 0.01 * k, 19.0, "") for k, s in enumerate("ABC")]
    visits = [(f"D{d}T{k}", f"{s}{d}", n, clock(25200 + 1800 * k + 300 * d + 180 * n), clock(25200 + 1800 * k + 300 * d + 180 * n)) for d in (0, 1) for k in (0, 1) for n, s in enumerate("ABC" if d == 0 else "CBA")]
    own = Feed({
        "stops": spark.createDataFrame(stops, "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string"),
        "routes": spark.createDataFrame([("M1", "1")], "route_id string, route_type string"),
        "trips": spark.createDataFrame([(f"D{d}T{k}", "M1", "WD") for d in (0, 1) for k in (0, 1)], "trip_id string, route_id string, service_id string"),
        "stop_times": spark.createDataFrame(visits, "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string"),
    })
    net = modal.build(own)
    assert {(r.i, r.j) for r in net.edges.collect()} == {("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")}
    assert all(r.mu > 0 for r in net.nodes.collect()) and modal.connected(net)
    scores = {r.node: r for r in modal.resilience(net, n_rounds=60).collect()}
    assert set(scores) == {"A", "B", "C"} and scores["B"].d_kemeny == 1 and 0 <= scores["A"].criticality <= 1
    assert all(r.pi > 0 for r in chain.stationary(net.chain(), n_rounds=30).collect())

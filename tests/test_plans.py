import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railyard.fixpoint import NotConverged
from railyard.operators import graph, order, spatial, stats
from railyard.plans import chain, demand, layers, scenario, simulate
from railyard.sources import feed


def cycle(spark, n):
    return spark.createDataFrame([("m", i, (i + 1) % n, 1.0) for i in range(n)], "mode string, i int, j int, p double")


def test_directed_cycle(spark):
    n = 60
    row = chain.diagnostics(cycle(spark, n)).first()
    assert row.efficiency == pytest.approx(sum(1 / k for k in range(1, n)) / (n - 1))
    assert row.irreducible and row.periodic and row.gap == pytest.approx(0, abs=1e-9)
    pi = chain.stationary(cycle(spark, 6), n_rounds=5).collect()
    assert all(r.pi == pytest.approx(1 / 6) for r in pi)


def test_two_state_flux_leap_and_edge_rate(spark):
    pi = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5)], "mode string, node string, pi double")
    mu = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 3.0)], "mode string, i string, mu double")
    assert [r.flux for r in chain.departure_flux(pi, mu).collect()] == pytest.approx([0.75, 0.75])
    state = spark.createDataFrame([("m", "a", 10.0), ("m", "b", 0.0)], "mode string, node string, n double")
    rates = spark.createDataFrame([("m", "a", 0.2), ("m", "b", 50.0)], "mode string, i string, mu double")
    assert chain.largest_leap(state, rates, 1.0, 0.03).first()[0] == pytest.approx(0.15)
    one = chain.kernel(spark.createDataFrame([("m", "a", "b", 77.0)], "mode string, i string, j string, cost double"))
    q = {(r.i, r.j): r.q for r in chain.generator(one, spark.createDataFrame([("m", "a", 1 / 600)], "mode string, i string, mu double")).collect()}
    assert q == {("a", "b"): pytest.approx(1 / 600), ("a", "a"): pytest.approx(-1 / 600)}


def random_chain(n, seed, density=0.5):
    rng = np.random.default_rng(seed)
    p = rng.random((n, n)) * (rng.random((n, n)) < density)
    np.fill_diagonal(p, 0)
    p[np.arange(n), (np.arange(n) + 1) % n] += 0.2
    return p / p.sum(1, keepdims=True)


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10**6))
def test_kemeny_is_the_trace_of_the_fundamental_matrix(n, seed):
    p = random_chain(n, seed)
    values, left = np.linalg.eig(p.T)
    pi = np.real(left[:, np.argmin(np.abs(values - 1))])
    pi /= pi.sum()
    z = np.linalg.inv(np.eye(n) - p + np.outer(np.ones(n), pi))
    assert chain.kemeny(p) == pytest.approx(np.trace(z) - 1, rel=1e-6)


def test_transient_is_the_matrix_exponential(spark):
    p = random_chain(5, 3)
    q = (p - np.eye(5)) * 0.7
    rows = [("m", i, j, float(q[i, j])) for i in range(5) for j in range(5) if q[i, j]]
    frame = spark.createDataFrame(rows, "mode string, i int, j int, q double")
    start = spark.createDataFrame([("m", i, float(10 * i)) for i in range(5)], "mode string, node int, v double")
    got = {r.node: r.n for r in chain.transient(frame, start, 2.0, 30).collect()}
    values, right = np.linalg.eig(q)
    exact = (np.arange(5) * 10) @ (right @ np.diag(np.exp(2 * values)) @ np.linalg.inv(right)).real
    assert [got[i] for i in range(5)] == pytest.approx(exact.tolist(), rel=1e-8)
    assert chain.conservation_error(start, chain.transient(frame, start, 2.0, 30)).first()[0] < 1e-12
    chain.assert_valid(frame, spark.createDataFrame([("m", i, j, float(p[i, j])) for i in range(5) for j in range(5) if p[i, j]], "mode string, i int, j int, p double"))


def test_removals_match_direct_numbers(spark):
    p = random_chain(6, 8)
    frame = spark.createDataFrame([("m", i, j, float(p[i, j])) for i in range(6) for j in range(6) if p[i, j]], "mode string, i int, j int, p double")
    base = (chain.kemeny(p), chain.gap(p), chain.hop_efficiency(p))
    for r in chain.removals(frame).collect():
        assert (r.d_kemeny, r.d_gap, r.d_efficiency, r.vulnerability) == pytest.approx(chain.drops(p, r.node, base))
    pairs = {(r.removed, r.i): 0.0 for r in graph.remove_node(frame, frame.select(F.col("i").alias("removed")).distinct()).collect()}
    for r in graph.remove_node(frame, frame.select(F.col("i").alias("removed")).distinct()).collect():
        pairs[r.removed, r.i] += r.p
    assert all(v == pytest.approx(1) for v in pairs.values())


def floyd(w):
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def planar(n, seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((n, n)) < 0.25, rng.uniform(10, 100, (n, n)), np.inf)
    w = np.minimum(w, w.T)
    np.fill_diagonal(w, np.inf)
    return w


def test_shortest_and_paths(spark):
    w = planar(14, 2)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(14) for j in range(14) if np.isfinite(w[i, j])], "i int, j int, cost double")
    d = floyd(w)
    times = graph.shortest(edges)
    got = {(r.source, r.node): r.t for r in times.collect()}
    names = {r.i for r in edges.collect()}
    assert all(got.get((i, j), np.inf) == pytest.approx(d[i, j]) for i in names for j in names)
    way = graph.path(times, 0, 9)
    assert sum(w[a, b] for a, b in zip(way, way[1:], strict=False)) == pytest.approx(d[0, 9])
    assert graph.path(times, 0, 99) == []
    assert graph.irreducible(edges) == np.isfinite(d).all()
    pieces = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "i int, j int")
    assert sorted(r.node for r in graph.giant(pieces).collect()) == [1, 2, 3]


def test_largest_eigenvalues_and_failing_loops(spark):
    rng = np.random.default_rng(4)
    p = rng.random((300, 300)) ** 6 + 30 * np.eye(300)[rng.permutation(300)]
    p = chain.stochastic(p)
    whole = np.sort(np.abs(np.linalg.eigvals(p)))[::-1]
    assert np.sort(np.abs(chain.largest(p, 20)))[::-1][:6] == pytest.approx(whole[:6], rel=0.03)
    few = chain.stochastic(np.ones((400, 400)) + 50 * np.eye(400)[::-1])
    assert chain.kemeny(few, chain.spectrum(few, dense=100)) == pytest.approx(chain.kemeny(few), rel=0.2)
    line = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "i int, j int, cost double")
    for loop in (lambda: graph.hops(line, most=3), lambda: graph.shortest(line, most=3, most_edges=0)):
        with pytest.raises(NotConverged):
            loop()
    with pytest.raises(Exception, match="still getting better"):
        graph.shortest(line, most=3).collect()


@pytest.mark.parametrize("kind", ["int", "string"])
def test_both_ways_to_shortest_times_agree(spark, kind):
    rng = np.random.default_rng(6)
    name = (lambda k: int(k)) if kind == "int" else (lambda k: f"n{k:03}")
    rows = [(g, name(a), name(b), float(c)) for g in "xy" for a, b, c in zip(rng.integers(0, 40, 130), rng.integers(0, 40, 130), rng.integers(1, 9, 130), strict=True)]
    edges = spark.createDataFrame(rows, f"g string, i {kind}, j {kind}, cost double")
    starts = spark.createDataFrame([(g, name(k)) for g in "xyz" for k in (0, 3, 7, 99)], f"g string, source {kind}")
    for own, asked, carry in ((edges, starts, ("g",)), (edges.drop("g"), None, ())):
        fast, slow = (graph.shortest(own, asked, carry, most_edges=m) for m in (10**6, 0))
        t = lambda df: {tuple(r[c] for c in (*carry, "source", "node")): r.t for r in df.collect()}
        rows_of = lambda df: sorted((*(r[c] for c in (*carry, "source", "node")), r.t, r.via is not None, r.via) for r in df.collect())
        assert rows_of(fast) == rows_of(slow) and len(t(fast)) > 200
        cost, times = {}, t(fast)
        for g, a, b, c in rows:
            cost[(g,) * len(carry) + (a, b)] = min(c, cost.get((g,) * len(carry) + (a, b), c))
        for r in fast.filter("node <> source").collect():
            g = (r["g"],) if carry else ()
            assert times[*g, r.source, r.via] + cost[*g, r.via, r.node] == r.t


@pytest.mark.parametrize("most_edges", [0, graph.MOST_EDGES])
def test_of_ways_with_equal_times_the_smallest_node_before_counts(spark, most_edges):
    edges = spark.createDataFrame([("s", "z", 1.0), ("z", "t", 1.0), ("s", "a", 0.5), ("a", "b", 0.5), ("b", "t", 1.0)], "i string, j string, cost double")
    assert graph.path(graph.shortest(edges, most_edges=most_edges), "s", "t") == ["s", "a", "b", "t"]


def test_strong_components_and_breaking_nodes(spark):
    rng = np.random.default_rng(8)
    for n, m in ((12, 16), (15, 30), (9, 40)):
        a = np.zeros((n, n), bool)
        a[rng.integers(0, n, m), rng.integers(0, n, m)] = True
        np.fill_diagonal(a, False)
        reach = np.linalg.matrix_power(np.eye(n) + a, n) > 0
        rows = [(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)]
        there = sorted({x for r in rows for x in r})
        edges = spark.createDataFrame(rows, "i int, j int")
        assert {r.node: r.label for r in graph.strong_components(edges).collect()} == {i: min(j for j in there if reach[i, j] and reach[j, i]) for i in there}
        sub = lambda keep: np.linalg.matrix_power(np.eye(len(keep)) + a[np.ix_(keep, keep)], max(1, len(keep))) > 0
        assert graph.irreducible(edges) == bool(sub(there).all())
        assert {r.node: r.breaks for r in graph.breaking_nodes(edges).collect()} == {g: not sub([x for x in there if x != g]).all() for g in there}


def test_events_and_snapshots(spark):
    q = spark.createDataFrame([("m", "a", "b", 1.0), ("m", "b", "a", 2.0), ("m", "b", "c", 1.0), ("m", "c", "a", 0.5)], "mode string, i string, j string, q double")
    start = spark.createDataFrame([("m", "a", 30.0), ("m", "b", 5.0)], "mode string, node string, n double")
    log = sorted(simulate.event_log(q, start, 2.0, runs=2).collect(), key=lambda r: (r.run, r.k))
    shots = simulate.snapshots(q, start, 2.0, 10, runs=2).collect()
    for run in (0, 1):
        people, at = {"a": 30, "b": 5, "c": 0}, {0: {"a": 30, "b": 5, "c": 0}}
        own = [r for r in log if r.run == run]
        assert [r.k for r in own] == list(range(1, len(own) + 1)) and all(x.t <= y.t <= 2.0 for x, y in zip(own, own[1:]))
        for r in own:
            people[r.node] -= 1
            people[r.to_node] += 1
            if r.k % 10 == 0:
                at[r.k] = dict(people)
        got = {}
        for r in shots:
            if r.run == run:
                got.setdefault(r.k, {})[r.node] = r.n
        assert got == at and len(got) > 3
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            simulate.event_ensemble(q, start, bad)


def test_water_districts_and_order(spark, tmp_path):
    import json

    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = [("west", "Polygon", [square(0, 0, 10), square(4, 4, 2)]), ("point", "Point", [1, 2]), ("east", "MultiPolygon", [[square(10, 0, 10)], [square(30, 0, 5), square(31, 1, 1)]])]
    (tmp_path / "d.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": n}, "geometry": {"type": k, "coordinates": c}} for n, k, c in shapes]}))
    corners = feed.districts(spark, str(tmp_path / "d.json"), expected=2, name="n")
    points = spark.createDataFrame([(0, 1.0, 1.5), (1, 5.0, 5.5), (2, 15.0, 2.5), (3, 31.5, 1.5), (4, 33.0, 3.5), (5, 25.0, 1.5)], "p int, x double, y double")
    named = spatial.inside(points, corners).join(corners.select("polygon", "name").distinct(), "polygon")
    assert {r.p: r.name for r in named.collect()} == {0: "west", 2: "east", 4: "east"}
    axis = spatial.shared_borders(corners, corners.select("polygon", F.col("name").alias("side")).distinct())
    assert [tuple(r) for r in axis.collect()] == [(10.0, 0.0, 10.0, 10.0)]
    with pytest.raises(ValueError):
        feed.districts(spark, str(tmp_path / "d.json"), expected=3)
    rng = np.random.default_rng(2)
    ends = rng.uniform(0, 20, (200, 4))
    legs = spark.createDataFrame([(k, *map(float, e)) for k, e in enumerate(ends)], "leg int, x1 double, y1 double, x2 double, y2 double")
    cross = {k for k, (x1, y1, x2, y2) in enumerate(ends) if (x1 - 10) * (x2 - 10) <= 0 and 0 <= y1 + (10 - x1) / (x2 - x1) * (y2 - y1) <= 10}
    assert {r.leg for r in spatial.crossing(legs, axis, "leg", 3.0).collect()} == cross and 20 < len(cross) < 150
    curve = spark.createDataFrame([(float(k), float(k * k % 7)) for k in range(0, 50, 3)], "t double, v double")
    at = spark.createDataFrame([(k, float(x)) for k, x in enumerate(rng.uniform(-5, 60, 300))] + [(999, 6.0), (1000, 6.0), (1001, None)], "k int, t double")
    want = {r.k: None if r.t is None else float(np.interp(r.t, range(0, 50, 3), [k * k % 7 for k in range(0, 50, 3)])) for r in at.collect()}
    assert {r.k: r.v for r in spatial.interpolate(curve, at).collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    values = [float(x) for x in rng.integers(0, 40, 500)]
    ranks = {r.x: r["rank"] for r in order.average_ranks(spark.createDataFrame([(v,) for v in values] + [(None,)], "x double"), "x").collect()}
    assert ranks == {v: np.mean([k + 1 for k, x in enumerate(sorted(values)) if x == v]) for v in set(values)}


def test_corridor_spacing(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 5.0), (1, 4000.0, 0.0, 5.0), (2, 1500.0, 50.0, 9.0), (3, 1800.0, 0.0, 8.0), (4, 2600.0, -100.0, 1.0), (5, 2000.0, 900.0, 50.0)], "hub int, x double, y double, weight double")
    ends = points.filter("hub < 2")
    row = scenario.corridors(ends, points.filter("hub > 1"), 800.0, 250.0, 2000.0, 10000.0, 1.2).first()
    assert row.hubs == [0, 2, 4, 1]


def test_demand_conservation_and_blocks(spark):
    rng = np.random.default_rng(1)
    n = 8
    times = spark.createDataFrame([(i, j, float(rng.uniform(300, 3000))) for i in range(n) for j in range(n) if i != j], "o int, d int, t double")
    made = spark.createDataFrame([(i, float(rng.uniform(1, 5)), i % 3) for i in range(n)], "o int, made double, k int")
    drawn = spark.createDataFrame([(i, float(rng.uniform(1, 5)), i % 3) for i in range(n)], "d int, drawn double, l int")
    od = demand.balanced(times, made.drop("k"), drawn.drop("l"), 1e-3)
    total = {r.o: r.w for r in od.groupBy("o").agg(F.sum("w").alias("w")).collect()}
    assert all(total[r.o] == pytest.approx(r.made, rel=1e-6) for r in made.collect())
    assert demand.unbalanced_mass(od, made).first()[0] < 1e-5
    quotas = spark.createDataFrame([(a, b, 10.0 + a + b) for a in range(3) for b in range(3)], "k int, l int, q double")
    spread = demand.blocks(times, made, drawn, quotas, 1e-3).join(made.select("o", "k"), "o").join(drawn.select("d", "l"), "d").groupBy("k", "l").agg(F.sum("w").alias("w"))
    assert all(r.w == pytest.approx(10 + r.k + r.l) for r in spread.collect())
    beta = demand.calibrate_beta(times, made.drop("k"), drawn.drop("l"), 1400.0, steps=18)
    assert demand.mean_time(demand.production(times, made.drop("k"), drawn.drop("l"), beta), times).first()[0] == pytest.approx(1400, rel=1e-2)
    with pytest.raises(ValueError):
        demand.service_prior(spark.createDataFrame([("a", 0.0)], "stop string, mu double"), 10.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_bounded_least_squares_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a, y = rng.normal(size=(7, 4)), rng.normal(size=7) * 2
    x = demand.bounded_least_squares(a, y, 0.0, 1.0)
    slope = a.T @ (a @ x - y)
    assert ((x >= -1e-12) & (x <= 1 + 1e-12)).all()
    assert all(abs(g) < 1e-7 if 1e-9 < v < 1 - 1e-9 else (g > -1e-7 if v < 0.5 else g < 1e-7) for v, g in zip(x, slope, strict=True))


def test_planted_multipliers_and_constants():
    rng = np.random.default_rng(4)
    g, mu = rng.uniform(1, 5, (5, 3)), np.array([0.7, 1.3, 1.1])
    assert demand.multipliers(g, g @ mu, 1e-9) == pytest.approx(mu, rel=1e-3)
    path = demand.ridge_path(g, g @ mu)
    assert len(path) == 36 and path[0]["rms"] < path[-1]["rms"]
    assert demand.rank_of(g)[0] == 3
    base = np.array([0.2, 0.3, 0.5])

    def shares(delta):
        x = base * np.exp([delta.get(k, 0.0) for k in "abc"])
        return dict(zip("abc", x / x.sum(), strict=True))

    target = shares({"a": 0.8, "b": -0.5})
    found = demand.fit_class_constants(shares, target, ["a", "b"])
    assert (found["a"], found["b"]) == pytest.approx((0.8, -0.5), abs=1e-5)


def test_simulation_conserves_and_follows_the_law(spark):
    p = random_chain(4, 1)
    moves = simulate.Moves(*np.nonzero(p), (p * 0.5)[np.nonzero(p)], 4)
    n0 = np.array([400.0, 0, 100, 0])
    n, k, complete = simulate.events(moves, n0, 1.0, 0)
    assert n.sum() == 500 and (n >= 0).all() and complete and k > 0
    assert not simulate.events(moves, n0, 1e9, 0, most=10)[2]
    states, _ = simulate.leaps(moves, n0, np.linspace(0, 1, 5), 0, tau=0.05, epsilon=1.0)
    assert (states.sum(1) == 500).all() and (states >= 0).all() and (states[0] == n0).all()
    q = (p - np.eye(4)) * 0.5
    values, right = np.linalg.eig(q)
    law = n0 @ (right @ np.diag(np.exp(values)) @ np.linalg.inv(right)).real
    mean = np.mean([simulate.events(moves, n0, 1.0, s)[0] for s in range(60)], axis=0)
    assert np.abs(mean - law).sum() / law.sum() < 0.03
    assert simulate.whole_people([1.5, 1.5, 0.2]).tolist() == [2, 1, 0]
    with pytest.raises(ValueError):
        simulate.whole_people([-1.0])


def test_spatial(spark):
    rng = np.random.default_rng(0)
    left, right = rng.uniform(0, 3000, (150, 2)), rng.uniform(0, 3000, (80, 2))
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(left)], "a int, lx double, ly double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(right)], "b int, rx double, ry double")
    d = np.sqrt(((left[:, None] - right[None]) ** 2).sum(2))
    assert {(r.a, r.b) for r in spatial.within(a, b, 250.0, ["a"], ["b"]).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 250)), strict=True))
    assert {r.a: r.b for r in spatial.snap(a, b, 250.0, "a", "b").collect()} == {i: int(d[i].argmin()) if d[i].min() <= 250 else None for i in range(150)}
    shapes = spark.createDataFrame([("T", 0, 0.0, 0.0, "t", "tram"), ("T", 1, 1000.0, 0.0, "t", "tram"), ("T", 2, 1000.0, 1000.0, "t", "tram"), ("B", 0, 0.0, 0.0, "b", "bus"), ("B", 1, 1000.0, 1000.0, "b", "bus")], "shape string, seq int, x double, y double, route string, kind string")
    streets = spatial.street_edges(shapes)
    both = lambda e: e.select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("length").alias("cost")).unionByName(e.select(F.col("v").alias("i"), F.col("u").alias("j"), F.col("length").alias("cost")))
    for edges, want in ((streets, 1414), (spatial.main_roads(streets), 2000)):
        start = both(edges).filter("i.a = 0 and i.b = 0").select(F.col("i").alias("source")).distinct()
        end = graph.shortest(both(edges), start).filter("node.a = 25 and node.b = 25").first()
        assert end.t == pytest.approx(want, rel=0.06)


def test_stats_small(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0)], "k string, id int, x double")
    assert stats.gini(df, ["k"], "x", "id").first().gini == 0
    curve = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0)], "t double, v double")
    at = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (50.0,)], "t double")
    assert [r.v for r in spatial.interpolate(curve, at).orderBy("t").collect()] == [1, 1, 2, 3, 3]


def test_streams(spark, tmp_path):
    from railyard.streaming import departures

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "a" if m < 30 else "b", "t1") for h in range(6) for m in (0, 10, 50)]
    spark.createDataFrame(rows, "ts string, stop string, trip string").selectExpr("cast(ts as timestamp) as ts", "stop", "trip").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, stop string, trip string").parquet(str(tmp_path / "in"))
    for name, df in (("rates", departures.rates(stream)), ("sessions", departures.sessions(stream))):
        query = df.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert {(str(r.start)[11:13], r.stop): r.departures for r in spark.table("out_rates").collect()}.get(("00", "a")) == 4
    assert spark.table("out_sessions").filter("visits = 3").count() + spark.table("out_sessions").filter("visits = 2").count() + spark.table("out_sessions").filter("visits = 1").count() > 0


def test_layers(spark):
    stops = spark.createDataFrame([("a", "Deák (x)", 47.5, 19.0), ("b", "Deák", 47.502, 19.0), ("c", "Deák", 47.505, 19.0), ("d", "Other", 47.5, 19.0)], "stop string, name string, lat double, lon double")
    # c is near b, but b is not the first of its area
    assert {r.stop: r.area for r in layers.merge_areas(stops).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    edges = spark.createDataFrame([("a", "d", 10.0), ("b", "d", 30.0), ("a", "b", 5.0)], "i string, j string, cost double")
    places = spark.createDataFrame([("a", 47.5, 19.0), ("d", 47.51, 19.0)], "node string, lat double, lon double")
    own = layers.layer_edges(edges, layers.merge_areas(stops), places)
    row = own.first()
    assert (row.i, row.j, row.cost) == ("a", "d", 20.0) and layers.cost_per_metre(own).first()[0] == pytest.approx(20 / row.m)
    # a street of ten blocks, and one around a corner to node 12
    at = {**{k: (100.0 * k, 0.0) for k in range(11)}, 11: (0.0, 800.0), 12: (100.0, 800.0)}
    nodes = spark.createDataFrame([(k, *xy) for k, xy in at.items()], "node int, x double, y double")
    ways = [(k, k + 1, 100.0) for k in range(10)] + [(0, 11, 800.0), (11, 12, 100.0)]
    street = spark.createDataFrame(ways + [(b, a, c) for a, b, c in ways], "i int, j int, cost double")
    pool = spark.createDataFrame([(7, 0.0, 20.0, 1.0), (8, 210.0, 0.0, 2.0), (9, 640.0, 100.0, 9.0), (10, 1000.0, 0.0, 1.0), (11, 500.0, 900.0, 8.0), (12, 400.0, 10.0, 5.0), (13, 120.0, 800.0, 1.0), (14, 300.0, 0.0, 5.0)], "hub int, x double, y double, weight double")
    snapped = spark.createDataFrame([(7, 0), (10, 10), (13, 12)], "hub int, node int")
    pairs = spark.createDataFrame([(7, 10), (7, 13), (10, 13)], "a int, b int")
    lines = {(r.a, r.b): r for r in layers.street_lines(street, snapped, pairs, nodes, pool, 250.0, 500.0, 1500.0).collect()}
    # 9 is taken first, 12 is too near to it, then 14; 8 is too near to 14. From 10 to 13 it is too long
    assert [x.hub for x in lines[7, 10].stations] == [7, 14, 9, 10] and lines[7, 10].length == 1000
    assert [x.hub for x in lines[7, 13].stations] == [7, 13] and (10, 13) not in lines
    assert not layers.street_lines(street, snapped, pairs, nodes, pool, 250.0, 500.0, 1500.0, most_detour=1.05).filter("b = 13").count()
    line = spark.createDataFrame([("L", "tram", k, h) for k, h in enumerate((13, 7, 10))], "line string, kind string, k int, hub int")
    assert [r.next_m for r in layers.routed_line(street, snapped, line).orderBy("k").collect()] == [900, 1000, None]
    with pytest.raises(ValueError):
        layers.routed_line(street, snapped.filter("hub <> 7"), line)
    assert [r["worst"] for r in layers.robustness(lambda v, x: {"a": x, "b": -x}[v], [1, 2, 3], ["a", "b"])] == [3, 2, 3]
    assert len(layers.sensitivity(lambda a, b: {"c": a * b}, a=[1, 2], b=[3, 4])) == 4
    assert layers.package_effect(lambda lines: float(sum(lines) + (len(lines) > 1)), [1.0, 2.0])["interaction"] == pytest.approx(4 / 3)

"""Components, failed nodes by the trees of ways, and links by the risk they leave, against solving everything again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from railyard.operators import graph
from railyard.plans import links, scenario


def floyd(w):
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def random_graph(n, seed, p=0.25):
    """Whole costs, so that there are ties; not every pair has a way."""
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((n, n)) < p, rng.integers(1, 9, (n, n)).astype(float), np.inf)
    np.fill_diagonal(w, np.inf)
    return w


def gone(w, k):
    out = w.copy()
    out[k], out[:, k] = np.inf, np.inf
    return floyd(out)


def edges_of(spark, w, name=int, kind="int"):
    return spark.createDataFrame([(name(i), name(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.isfinite(w)), strict=True)], f"i {kind}, j {kind}, cost double")


@pytest.mark.parametrize(("seed", "kind"), [(0, "int"), (1, "string"), (2, "int")])
def test_failures_are_what_solving_again_says(spark, seed, kind):
    n, name = 13, (int if kind == "int" else lambda k: f"n{k:02}")
    w = random_graph(n, seed)
    edges = edges_of(spark, w, name, kind)
    times = graph.shortest(edges)
    rows = graph.failures(edges, times).collect()
    changed = {(r.removed, r.source, r.node): (r.before, r.t) for r in rows}
    assert len(changed) == len(rows) > 20 and any(t is None for _, t in changed.values())
    base, there = floyd(w), [k for k in range(n) if np.isfinite(w[k]).any() or np.isfinite(w[:, k]).any()]
    for k in there:
        without = gone(w, k)
        for a in there:
            for b in there:
                if a != b and k not in (a, b):
                    before, t = changed.get((name(k), name(a), name(b)), (base[a, b], base[a, b]))
                    assert before == base[a, b] and (np.inf if t is None else t) == without[a, b]


def test_failures_relax_few_pairs_of_a_street_grid(spark):
    side, rng = 9, np.random.default_rng(1)
    n = side * side
    rows = [(a, b, float(c)) for x in range(side) for y in range(side) for a, b in ((x * side + y, x * side + y + 1), (x * side + y, x * side + y + side)) for c in [rng.uniform(1, 2)] if b < n and (b - a > 1 or b % side)]
    edges = spark.createDataFrame(rows + [(b, a, c) for a, b, c in rows], "i int, j int, cost double")
    changes = graph.failures(edges, graph.shortest(edges))
    relaxed = changes.count()
    assert n * n < relaxed < n**3 / 10


def test_no_way_goes_through_a_node(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i int, j int, cost double")
    assert graph.failures(edges, graph.shortest(edges)).count() == 0
    assert graph.failures(edges.limit(0), graph.shortest(edges.limit(0))).count() == 0


def sums(t, w, k):
    keep = np.arange(len(t)) != k
    part, time = w[np.ix_(keep, keep)], t[np.ix_(keep, keep)]
    return np.divide(part, time, out=np.zeros_like(part), where=time > 0).sum()


def test_sums_after_failures(spark):
    w = random_graph(11, 5, 0.3)
    edges, mass = edges_of(spark, w), np.random.default_rng(5).random(11)
    weights = np.outer(mass, mass)
    np.fill_diagonal(weights, 0)
    od = spark.createDataFrame([(a, b, float(weights[a, b])) for a in range(11) for b in range(11) if a != b], "o int, d int, w double")
    times = graph.shortest(edges)
    base = times.filter("source <> node").select(F.col("source").alias("o"), F.col("node").alias("d"), "t")
    got = scenario.after_failures(base, graph.failures(edges, times), od).collect()
    assert len(got) == 11
    for r in got:
        assert (r.before, r.after) == (pytest.approx(sums(floyd(w), weights, r.k)), pytest.approx(sums(gone(w, r.k), weights, r.k)))
    v = {r.k: r.v for r in scenario.vulnerability_of(scenario.after_failures(base, graph.failures(edges, times), od)).collect()}
    assert v[3] == pytest.approx(1 - sums(gone(w, 3), weights, 3) / sums(floyd(w), weights, 3))


@pytest.mark.parametrize("seed", range(2))
def test_scores_are_what_solving_again_says(spark, seed):
    n, alpha = 10, 0.3
    w = random_graph(n, seed + 20)
    edges, mass = edges_of(spark, w), np.random.default_rng(seed).random(n)
    weights = np.outer(mass, mass)
    np.fill_diagonal(weights, 0)
    weights /= weights.sum()
    times = graph.shortest(edges)
    failing = [k for k in range(n) if np.isfinite(w[k]).any() or np.isfinite(w[:, k]).any()]
    scorer = links.Scorer([f"x{k}" for k in range(n)], floyd(w), weights, graph.failures(edges, times).select(*(F.concat(F.lit("x"), c).alias(c) for c in ("removed", "source", "node")), "t"), edges.select(F.explode(F.array(*(F.concat(F.lit("x"), c) for c in "ij"))).alias("node")), alpha)

    def risk(more):
        own = w.copy()
        for a, b, c in more:
            own[a, b], own[b, a] = min(own[a, b], c), min(own[b, a], c)
        v = [1 - sums(gone(own, k), weights, k) / sums(floyd(own), weights, k) for k in failing]
        return alpha * np.mean(v) + (1 - alpha) * np.max(v)

    tried = [(a, b, 2.0 + (a + b) % 3) for a in range(n) for b in range(a + 1, n) if not np.isfinite(w[a, b]) and not np.isfinite(w[b, a])][:7]
    assert {r.id: r.j for r in scorer.singles(tried).collect()} == {k: pytest.approx(risk([x])) for k, x in enumerate(tried)}
    assert {r.id: r.j for r in scorer.singles(tried[2:], tried[:2]).collect()} == {k: pytest.approx(risk([*tried[:2], x])) for k, x in enumerate(tried[2:])}
    pairs = {(r.m, r.n): r.j for r in scorer.pairs(tried).collect()}
    assert pairs == {(a, b): pytest.approx(risk([tried[a], tried[b]])) for a in range(len(tried)) for b in range(a + 1, len(tried))}
    best = scorer.best(tried, 2)
    assert best[0][1] == pytest.approx(min(risk([x]) for x in tried)) and best[1][1] == pytest.approx(min(risk([best[0][0], x]) for x in tried if x != best[0][0]))
    assert scorer.best(tried[:1], 5)[0][0] == tried[0] and scorer.pairs(tried[:1]).count() == 0


def test_too_many_nodes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(links, "MOST", 2)
    with pytest.raises(ValueError, match="more than 2"):
        links.Scorer([1, 2, 3], np.zeros((3, 3)), np.ones((3, 3)), None, None)


@pytest.mark.parametrize("hot", [graph.HOT, 3])
def test_components_by_stars(spark, hot):
    rng = np.random.default_rng(4)
    chain = [(k, k + 1) for k in range(300, 420)]
    star = [(900, 500 + k) for k in range(60)]
    rows = [(int(a), int(b)) for a, b in zip(rng.permutation(200)[:90], rng.permutation(200)[:90], strict=True)] + chain + star + star[:9] + [(7, 7), (1000, 1000)]
    label = {x: x for r in rows for x in r}
    for _ in label:
        for a, b in rows:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(rows, "i int, j int"), hot=hot).collect()
    assert len(got) == len(label) and {r.node: r.label for r in got} == label
    named = graph.components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "i string, j string"), hot=hot).collect()
    assert {r.node: r.label for r in named} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.components(spark.createDataFrame([], "i int, j int")).count() == 0


def test_rows_of_a_hot_key_are_spread(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), "id").union(spark.range(400).select((F.col("id") + 2).cast("int").alias("k"), "id")).repartition(8)
    one = spark.range(500).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("x"))
    out = graph.spread_join(rows, one, "k", most=1000)
    assert out.filter("x <> 2 * k").count() == 0 and out.count() == 4400
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * sum(sizes) / 8

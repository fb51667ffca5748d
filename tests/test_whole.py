"""Queries against dense solutions of the whole problem."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from railyard import catalogue
from railyard.plans import chain, linenet, links, simulate
from railyard.queries import chains, demand, plans
from railyard.queries import tables as t

SF = "/root/testdata/sf0.001"


def dense_times(rows, gone=None):
    """All-pairs least costs by Floyd and Warshall, {(source, node): t}."""
    names = sorted({x for r in rows for x in (r.i, r.j)} - {gone})
    at = {x: k for k, x in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    np.fill_diagonal(d, 0)
    for r in rows:
        if gone not in (r.i, r.j):
            d[at[r.i], at[r.j]] = min(d[at[r.i], at[r.j]], r.cost)
    for k in range(len(names)):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return {(a, b): d[at[a], at[b]] for a in names for b in names if np.isfinite(d[at[a], at[b]])}


def test_network_queries_use_every_edge(spark):
    rows = t.hub_costs(spark, SF).collect()
    want = dense_times(rows)
    got = {(r.source, r.node): r.t for r in catalogue.QUERIES["shortest_times"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    hops = {(r.source, r.node): r.d for r in catalogue.QUERIES["bfs_hops"](spark, SF).collect()}
    assert {k for k, d in hops.items() if d == 1} == {(r.i, r.j) for r in rows}

    people = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/customer.parquet").groupBy("c_nationkey").count().collect()}
    sum_of = lambda d, k: sum(people.get(o, 0) * people.get(x, 0) / v for (o, x), v in d.items() if o != x and k not in (o, x))
    loss = {r.k: r.v for r in catalogue.QUERIES["vulnerability"](spark, SF).collect()}
    assert loss == {k: pytest.approx(1 - sum_of(dense_times(rows, k), k) / sum_of(want, k), abs=1e-7) for k in loss}
    assert len(loss) == len({r.i for r in rows} | {r.j for r in rows})


def test_new_links_are_those_the_network_lacks(spark):
    edges = {frozenset((r.i, r.j)) for r in t.regional_graph(spark, SF).collect()}
    risks = {(r.a, r.b): r.j for r in catalogue.QUERIES["link_risks"](spark, SF).collect()}
    first = catalogue.QUERIES["greedy_links"](spark, SF).orderBy("step").first()
    assert first.j == pytest.approx(min(risks.values()), abs=1e-7) and risks[first.a, first.b] == pytest.approx(first.j, abs=1e-7)
    for name in ("candidate_links", "greedy_links"):
        assert not any(frozenset((r.a, r.b)) in edges for r in catalogue.QUERIES[name](spark, SF).collect())


def test_open_network_is_solved_to_the_end(spark):
    model = linenet.OpenModel(plans.line_network(spark, SF))
    rates, source = model.rates.collect(), {f"H{r.hub}": r.rate for r in plans.source(model).collect()}
    names = sorted({r.src for r in rates})
    at = {x: k for k, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rates:
        m[at[r.src], at[r.src]] += r.rate
        if r.dst != "exit":
            m[at[r.src], at[r.dst]] -= r.rate
    mass = np.linalg.solve(m.T, [source.get(x, 0.0) for x in names])
    got = {r.state: r.mass for r in catalogue.QUERIES["steady_state"](spark, SF).collect()}
    assert [got.get(x, 0.0) for x in names] == pytest.approx(mass, rel=1e-6, abs=2e-6)
    assert catalogue.QUERIES["journey_time"](spark, SF).first().seconds == pytest.approx(mass.sum() / sum(source.values()), rel=1e-8)
    flows = catalogue.QUERIES["network_flows"](spark, SF).collect()
    boarding = sum(mass[at[f"H{r.from_hub}"]] * r.q_board for r in model.segments.collect())
    assert sum(r.boarding for r in flows) == pytest.approx(boarding, rel=1e-6)


def test_stationary_law_is_the_limit(spark):
    own = chains.event_chain(spark, SF).collect()
    pi = {r.node: r.pi for r in catalogue.QUERIES["stationary_cesaro"](spark, SF).collect()}
    for node, mass in pi.items():
        assert sum(pi[r.i] * r.p for r in own if r.j == node) == pytest.approx(mass, abs=5e-8)
    mu = {r.i: r.mu for r in chains.event_rates(spark, SF).collect()}
    held = sum(v / mu[k] for k, v in pi.items())
    assert {r.node: r.flux for r in catalogue.QUERIES["departure_flux"](spark, SF).collect()} == {k: pytest.approx(v / held, rel=1e-6) for k, v in pi.items()}



def test_gravity_is_balanced(spark):
    larger = "/root/testdata/sf0.01"
    own = catalogue.QUERIES["gravity_ipf"](spark, larger).collect()
    for r in demand.origins(spark, larger).collect():
        assert sum(x.w for x in own if x.o == r.o) == pytest.approx(r.made, rel=1e-6)


def two_states(spark, rate):
    q = spark.createDataFrame([("m", "a", "b", rate), ("m", "a", "a", -rate), ("m", "b", "a", 0.25), ("m", "b", "b", -0.25)], "mode string, i string, j string, q double")
    return q, spark.createDataFrame([("m", "a", 100.0), ("m", "b", 0.0)], "mode string, node string, v double")


@pytest.mark.parametrize("rate", [31.0, 201.0])
def test_transient_takes_the_terms_it_needs(spark, rate):
    q, start = two_states(spark, rate)
    k = rate + 0.25
    want = 100 * (0.25 + rate * np.exp(-k)) / k
    got = {r.node: r.n for r in chain.transient(q, start, 1.0, conserve=False).collect()}
    assert got == {"a": pytest.approx(want, rel=1e-8), "b": pytest.approx(100 - want, rel=1e-8)}


@pytest.mark.parametrize("rate", [201.0, 20_000.0])
def test_fast_small_chains_take_no_series(spark, monkeypatch, rate):
    """Rate times time of the largest of these would be 100 series of about 300 rounds."""
    q, start = two_states(spark, rate)
    monkeypatch.setattr(chain, "rounds", lambda *_, **__: pytest.fail("a series"))
    k = rate + 0.25
    want = 100 * (0.25 + rate * np.exp(-k)) / k
    got = {r.node: r.n for r in chain.transient(q, start, 1.0).collect()}
    assert got == {"a": pytest.approx(want, rel=1e-11), "b": pytest.approx(100 - want, rel=1e-11)}


@pytest.mark.parametrize("most_squared", [0, chain.MOST_SQUARED])
def test_people_stay_at_nodes_without_rates(spark, most_squared):
    """From a to c, which has no row, or out of the chain; nobody gets to d. The series and the squares agree."""
    q = spark.createDataFrame([("m", "a", "c", 20.0), ("m", "a", "a", -25.0)], "mode string, i string, j string, q double")
    start = spark.createDataFrame([("m", "a", 100.0), ("m", "d", 7.0)], "mode string, node string, v double")
    got = {r.node: r.n for r in chain.transient(q, start, 0.1, conserve=False, most_squared=most_squared).collect()}
    left = np.exp(-2.5)
    assert got == {"a": pytest.approx(100 * left, rel=1e-9), "c": pytest.approx(80 * (1 - left), rel=1e-9), "d": pytest.approx(7.0, rel=1e-9)}


def test_runs_are_simulated_once(spark):
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    runs = spark.createDataFrame([(k, "m", "a", k % 3) for k in range(6)], "run long, mode string, node string, n long")
    law = spark.createDataFrame([("m", "a", 1.0)], "mode string, node string, n double")
    assert simulate.against_mean(runs.mapInPandas(one, runs.schema), law).first().mean == 1.0
    assert made.value == 6


def test_stopped_runs_are_refused(spark):
    q, start = two_states(spark, 31.0)
    start = start.withColumnRenamed("v", "n")
    assert simulate.against_mean(simulate.event_ensemble(q, start, 0.5, 3, most=None), start).count() == 2
    with pytest.raises(Exception, match="stopped before the horizon"):
        simulate.against_mean(simulate.event_ensemble(q, start, 0.5, 3, most=5), start).collect()


def test_hub_class_of_all_customers(spark):
    names = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey").distinct().collect()}
    assert {r.hub for r in catalogue.QUERIES["hub_class"](spark, SF).collect()} == names


def test_greedy_links_tries_every_candidate(spark, monkeypatch):
    asked, real = [], links.Scorer.singles
    monkeypatch.setattr(links.Scorer, "singles", lambda self, tried, fixed=(): asked.append(len(tried)) or real(self, tried, fixed))
    steps = catalogue.QUERIES["greedy_links"](spark, SF).collect()
    n = catalogue.QUERIES["link_risks"](spark, SF).count()
    assert asked[:3] == [n, n - 1, n - 2] and [r.step for r in steps] == [0, 1, 2]


def test_entry_without_a_dependency_of_the_training_data_part():
    """The other queries are there if what that part imports is missing."""
    code = "import sys; sys.modules['ahocorasick'] = sys.modules['tokenizers'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'softmax_kernel' in q and 'job1_service_days' in q and 'op6_benchmark_leaks' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)

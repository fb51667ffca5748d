"""Long-run laws against means of dense powers."""

import logging

import numpy as np
import pytest

from railyard.plans import stationary


def powers(p, doublings=60):
    """Limit of the mean of I, P, P^2, ... from the uniform law."""
    power, mean = p.copy(), np.eye(len(p))
    for _ in range(doublings):
        mean, power = (mean + power @ mean) / 2, power @ power
        mean, power = mean / mean.sum(1, keepdims=True), power / power.sum(1, keepdims=True)
    return mean.mean(0)


def chain_of(spark, matrices):
    rows = [(mode, int(i), int(j), float(p[i, j])) for mode, p in matrices.items() for i, j in zip(*np.nonzero(p), strict=True)]
    return spark.createDataFrame(rows, "mode string, i int, j int, p double")


def agrees(spark, matrices, size, tolerance=1e-11):
    got = {(r["mode"], r.node): r.pi for r in stationary.limit(chain_of(spark, matrices), size, tolerance).collect()}
    for mode, p in matrices.items():
        want = powers(p)
        assert [got[mode, k] for k in range(len(p))] == pytest.approx(want, rel=1e-6, abs=1e-10)
        assert sum(want) == pytest.approx(1)


def fixtures():
    rng = np.random.default_rng(2)
    whole = rng.random((9, 9)) ** 3
    cycle = np.roll(np.eye(6), 1, axis=1)
    sides = np.zeros((8, 8))  # steps from one half to the other
    sides[:4, 4:], sides[4:, :4] = rng.random((4, 4)), rng.random((4, 4))
    parts = np.zeros((9, 9))  # 0-2 and 3-4 keep what they get, 5 stays, 6-8 hand on
    parts[:3, :3], parts[3:5, 3:5], parts[5, 5] = rng.random((3, 3)), np.eye(2)[::-1], 1
    parts[6:, :] = rng.random((3, 9)) * (rng.random((3, 9)) < 0.6)
    parts[6, 0] = parts[7, 3] = parts[8, 6] = 0.2
    return {name: p / p.sum(1, keepdims=True) for name, p in {"whole": whole, "cycle": cycle, "sides": sides, "parts": parts, "alone": np.eye(1)}.items()}


def test_small_chains_of_all_kinds(spark):
    agrees(spark, fixtures(), stationary.SIZE)


def test_blocks(spark, caplog):
    """The same with blocks of a few nodes, and the rounds are told."""
    with caplog.at_level(logging.INFO, logger="railyard.plans.stationary"):
        agrees(spark, {k: p for k, p in fixtures().items() if k in ("whole", "sides")}, 4, 1e-9)
    assert "rounds of aggregation" in caplog.text


def test_a_long_line_of_blocks(spark):
    """A walk that steps to its neighbours mixes slowly: thousands of steps, few rounds of blocks."""
    n, rng = 16, np.random.default_rng(3)
    p = np.zeros((n, n))
    for k in range(n):
        for j in (k - 1, k + 1):
            if 0 <= j < n:
                p[k, j] = rng.uniform(0.5, 1)
    agrees(spark, {"line": p / p.sum(1, keepdims=True)}, 5, 1e-8)


def test_nodes_without_moves(spark):
    rows = spark.createDataFrame([("m", 1, 2, 1.0), ("m", 3, 2, 0.5), ("m", 3, 4, 0.5)], "mode string, i int, j int, p double")
    assert {r.node: r.pi for r in stationary.limit(rows).collect()} == {1: 0, 3: 0, 2: pytest.approx(0.625), 4: pytest.approx(0.375)}
    assert stationary.limit(rows.limit(0)).count() == 0

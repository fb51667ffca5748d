"""Gains of lines against a network that has their sections as links, and lazy choice against trying all."""

import numpy as np
import pytest

from railyard.plans import lines


def floyd(w):
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def network(n, seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((n, n)) < 0.25, rng.uniform(10, 100, (n, n)), np.inf)
    return floyd(np.minimum(w, w.T)), rng.random((n, n))


def by_pairs(t, stops, rides, headway, one_way):
    """Each pair of stops as a ride of its own."""
    cum, out = np.r_[0.0, np.cumsum(rides)], t.copy()
    for x, a in enumerate(stops):
        for y, b in enumerate(stops):
            if y > x or (y < x and not one_way):
                out = np.minimum(out, t[:, a, None] + headway / 2 + abs(cum[x] - cum[y]) + t[None, b])
    return out


def efficiency(t, w):
    off = ~np.eye(len(t), dtype=bool)
    return (w[off] / t[off])[np.isfinite(t[off])].sum() / w[off].sum()


@pytest.mark.parametrize("one_way", [False, True])
def test_times_with_a_line(one_way):
    for seed in range(5):
        t, _ = network(14, seed)
        stops, rides = [3, 9, 0, 12, 5], [20.0, 31.0, 4.0, 8.0]
        assert lines.with_line(t, stops, rides, 30.0, one_way) == pytest.approx(by_pairs(t, stops, rides, 30.0, one_way))


def frame(spark, rows):
    return spark.createDataFrame([(n, list(s), r, 30.0, p, key) for n, (s, r, p, key) in enumerate(rows)], "id long, stations array<int>, seconds array<double>, headway double, price double, key string")


def candidates(seed, m=25):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(2, 6, m)
    return [(rng.permutation(14)[:k].tolist(), rng.uniform(3, 30, k - 1).tolist(), float(rng.integers(1, 4)), f"k{n % 9}") for n, k in enumerate(sizes)]


@pytest.mark.parametrize(("at_once", "keyed"), [(1, False), (4, False), (32, True)])
def test_lazy_choice_is_trying_all(spark, at_once, keyed):
    t, w = network(14, 5)
    tried = candidates(6)
    df = frame(spark, tried) if keyed else frame(spark, tried).drop("key")
    own = lines.Network(t, w)
    assert own.efficiency() == pytest.approx(efficiency(t, w))
    got = {r.id: r.gain for r in lines.gains(own, df).collect()}
    assert got == {n: pytest.approx(efficiency(by_pairs(t, s, r, 30.0, False), w) / efficiency(t, w) - 1) for n, (s, r, *_) in enumerate(tried)}

    first, want, used = efficiency(t, w), [], set()
    for _ in range(4):
        now = efficiency(t, w)
        gain = {n: (efficiency(by_pairs(t, s, r, 30.0, False), w) - now) / first for n, (s, r, _, key) in enumerate(tried) if (key if keyed else n) not in used}
        n = max(gain, key=lambda n: (gain[n] / tried[n][2], -n))
        t = by_pairs(t, *tried[n][:2], 30.0, False)
        used.add(tried[n][3] if keyed else n)
        want.append((n, pytest.approx(gain[n])))
    steps = lines.best_lines(own, df, 4, at_once)
    assert [(x["id"], x["marginal"]) for x in steps] == want
    assert steps[-1]["total"] == pytest.approx(sum(x["marginal"] for x in steps)) and [x["step"] for x in steps] == [0, 1, 2, 3]


def test_as_many_as_there_are(spark):
    t, w = network(14, 5)
    assert len(lines.best_lines(lines.Network(t, w), frame(spark, candidates(6, 3)), 9)) == 3
    assert len(lines.best_lines(lines.Network(t, w), frame(spark, candidates(6, 20)), 99)) == 9  # a line for each key
    assert lines.best_lines(lines.Network(t, w), frame(spark, candidates(6, 3)).limit(0), 2) == []


def test_too_many_nodes_are_refused(monkeypatch):
    monkeypatch.setattr(lines, "MOST_NODES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        lines.Network(np.zeros((3, 3)), np.ones((3, 3)))

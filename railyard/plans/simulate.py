"""Stochastic simulation of passengers on generators: exact events, leaps, ensembles. A trajectory is sequential, so runs are
dealt to tasks; a run's seed is its number, so results don't depend on how they are dealt.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.fixpoint import cut


def whole_people(n: np.ndarray) -> np.ndarray:
    """Whole numbers by largest remainder with the rounded total."""
    n = np.asarray(n, float)
    if n.ndim != 1 or not np.isfinite(n).all() or (n < 0).any():
        raise ValueError("people must be a finite vector without negative numbers")
    base = np.floor(n)
    left = int(round(n.sum()) - base.sum())
    base[np.argsort(-(n - base), kind="stable")[:left]] += 1
    return base.astype(np.int64)


class Moves:
    """Channels of all modes: from state i to state j at rate q for each person; a state is a (mode, stop)."""

    def __init__(self, i: np.ndarray, j: np.ndarray, q: np.ndarray, n_states: int):
        order = np.argsort(i, kind="stable")
        self.i, self.j, self.q, self.n = i[order], j[order], q[order], n_states
        self.out = np.bincount(self.i, self.q, minlength=n_states)
        self.first = np.searchsorted(self.i, np.arange(n_states + 1))
        total = np.cumsum(self.q)
        before = np.r_[0.0, total][self.first[self.i]]
        self.cdf = self.i + (total - before) / np.where(self.out[self.i] > 0, self.out[self.i], 1)

    def lists(self) -> tuple[list[float], list[int], list[int], list[float]]:
        """(out, first, j, cdf) as lists, which are faster to look up one by one than arrays."""
        return self.out.tolist(), self.first.tolist(), self.j.tolist(), self.cdf.tolist()


#: States up to which their rates are summed up as a list, with the same sums.
FEW = 64


def events(moves: Moves, start: np.ndarray, horizon: float, seed: int, most: int | None = 500_000, seen: Callable[[float, int, int, np.ndarray], None] | None = None) -> tuple[np.ndarray, int, bool]:
    """Exact (direct) simulation: state at the end, number of events, whether the horizon was reached. most: events, None for no limit. seen: told the time, both states and the people after each event."""
    rng, n, t, k = np.random.default_rng(seed), whole_people(start), 0.0, 0
    out, first, to, cdf = moves.lists()
    rates = n * moves.out
    total = float(rates.sum())
    few = moves.n <= FEW
    if few:
        rates = rates.tolist()
    while most is None or k < most:
        if total <= 1e-15:
            return n, k, True
        t += rng.exponential(1 / total)
        if t > horizon:
            return n, k, True
        a = bisect_right(list(accumulate(rates)) if few else np.cumsum(rates), rng.random() * total)
        a = min(a, moves.n - 1)
        b = to[min(bisect_left(cdf, a + rng.random(), first[a], first[a + 1]), first[a + 1] - 1)]
        n[a] -= 1
        n[b] += 1
        rates[a], rates[b] = int(n[a]) * out[a], int(n[b]) * out[b]
        k += 1
        if seen is not None:
            seen(t, a, b, n)
        total = float(np.sum(rates)) if k % 1000 == 0 else total + (out[b] - out[a])
    return n, k, False


def leaps(moves: Moves, start: np.ndarray, grid: np.ndarray, seed: int, tau: float = 1.0, epsilon: float = 0.03) -> tuple[np.ndarray, int]:
    """States at the times of the grid by Poisson leaps of min(tau, epsilon / largest busy rate); what a state can't give is dealt out multinomially."""
    rng, n, t, steps = np.random.default_rng(seed), whole_people(start), 0.0, 0
    out = []
    for until in grid:
        while t < until - 1e-12:
            busy = moves.out[(n > 0) & (moves.out > 0)]
            if not len(busy):
                t = until
                break
            dt = min(tau, epsilon / busy.max(), until - t)
            moved = rng.poisson(n[moves.i] * moves.q * dt)
            asked = np.bincount(moves.i, moved, minlength=moves.n).astype(np.int64)
            for a in np.flatnonzero(asked > n):
                own = slice(moves.first[a], moves.first[a + 1])
                moved[own] = rng.multinomial(n[a], moved[own] / asked[a])
            n = n - np.bincount(moves.i, moved, minlength=moves.n).astype(np.int64) + np.bincount(moves.j, moved, minlength=moves.n).astype(np.int64)
            t += dt
            steps += 1
        out.append(n.copy())
    return np.array(out), steps


def _collected(q: DataFrame, start: DataFrame, most_channels: int):
    """Driver-side tables of a generator (mode, i, j, q) and people (mode, node, n); their size is checked."""
    rows = q.filter("i <> j and q > 0").select("mode", "i", "j", "q").limit(most_channels + 1).collect()
    if len(rows) > most_channels:
        raise ValueError("the generator has more channels than most_channels")
    people = {(r["mode"], r["node"]): r["n"] for r in start.select("mode", "node", "n").collect()}
    names = sorted({(r["mode"], r["i"]) for r in rows} | {(r["mode"], r["j"]) for r in rows} | set(people))
    at = {x: k for k, x in enumerate(names)}
    moves = Moves(np.array([at[r["mode"], r["i"]] for r in rows], dtype=np.int64), np.array([at[r["mode"], r["j"]] for r in rows], dtype=np.int64), np.array([r["q"] for r in rows], float), len(names))
    return names, moves, np.array([people.get(x, 0.0) for x in names], float)


def _runs(spark: SparkSession, runs: int) -> DataFrame:
    return spark.range(runs, numPartitions=min(runs, spark.sparkContext.defaultParallelism))


def event_ensemble(q: DataFrame, start: DataFrame, horizon: float, runs: int = 40, most: int | None = 500_000, most_channels: int = 2_000_000) -> DataFrame:
    """(run, mode, node, n, events, complete) of exact runs 0, 1, ..., each seeded by its number."""
    _checked(horizon, runs)
    names, moves, n0 = _collected(q, start, most_channels)
    shared = q.sparkSession.sparkContext.broadcast((moves, n0))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, n0 = shared.value
        for pdf in batches:
            for run in pdf["id"]:
                n, k, complete = events(moves, n0, horizon, int(run), most)
                yield pd.DataFrame({"run": run, "k": np.arange(moves.n), "n": n, "events": k, "complete": complete})

    return _named(_runs(q.sparkSession, runs).mapInPandas(simulate, "run long, k int, n long, events long, complete boolean"), names, q)


def event_log(q: DataFrame, start: DataFrame, horizon: float, runs: int = 1, most: int | None = 500_000, most_channels: int = 2_000_000) -> DataFrame:
    """(run, k, t, mode, node, to_mode, to_node): the events of exact runs in order, yielded as they pile up."""
    _checked(horizon, runs)
    names, moves, n0 = _collected(q, start, most_channels)
    shared = q.sparkSession.sparkContext.broadcast((moves, n0))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, n0 = shared.value
        for pdf in batches:
            for run in pdf["id"]:
                rows: list[tuple] = []
                events(moves, n0, horizon, int(run), most, lambda t, a, b, n, rows=rows: rows.append((t, a, b)))
                yield pd.DataFrame({"run": run, "n": np.arange(1, len(rows) + 1), "t": [r[0] for r in rows], "k": [r[1] for r in rows], "to": [r[2] for r in rows]})

    log = _runs(q.sparkSession, runs).mapInPandas(simulate, "run long, n long, t double, k int, to int")
    named = _named(_named(log, names, q).withColumnsRenamed({"mode": "__mode", "node": "__node", "to": "k"}), names, q)
    return named.select("run", F.col("n").alias("k"), "t", F.col("__mode").alias("mode"), F.col("__node").alias("node"), F.col("mode").alias("to_mode"), F.col("node").alias("to_node"))


def snapshots(q: DataFrame, start: DataFrame, horizon: float, every: int, runs: int = 1, most: int | None = 500_000, most_channels: int = 2_000_000) -> DataFrame:
    """(run, k, t, mode, node, n): the people of exact runs at the start (k = 0) and after each `every` events."""
    _checked(horizon, runs)
    names, moves, n0 = _collected(q, start, most_channels)
    shared = q.sparkSession.sparkContext.broadcast((moves, n0))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, n0 = shared.value
        for pdf in batches:
            for run in pdf["id"]:
                kept, count = [(0, 0.0, whole_people(n0))], [0]

                def seen(t: float, a: int, b: int, n: np.ndarray, kept=kept, count=count) -> None:
                    count[0] += 1
                    if count[0] % every == 0:
                        kept.append((count[0], t, n.copy()))

                events(moves, n0, horizon, int(run), most, seen)
                for at, t, n in kept:
                    yield pd.DataFrame({"run": run, "events": at, "t": t, "k": np.arange(moves.n), "n": n})

    out = _named(_runs(q.sparkSession, runs).mapInPandas(simulate, "run long, events long, t double, k int, n long"), names, q)
    return out.withColumnRenamed("events", "k")


def _checked(horizon: float, runs: int) -> None:
    if not (horizon > 0 and np.isfinite(horizon)) or runs < 1:
        raise ValueError("the horizon must be positive and there must be a run")


def leap_ensemble(q: DataFrame, start: DataFrame, horizon: float, runs: int = 10, points: int = 4, tau: float = 1.0, epsilon: float = 0.03, most_channels: int = 2_000_000) -> DataFrame:
    """(run, t, mode, node, n, steps) of leaping runs at evenly spaced times."""
    _checked(horizon, runs)
    if points < 2:
        raise ValueError("at least 2 points are needed")
    names, moves, n0 = _collected(q, start, most_channels)
    shared = q.sparkSession.sparkContext.broadcast((moves, n0))
    grid = np.linspace(0, horizon, points)

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, n0 = shared.value
        for pdf in batches:
            for run in pdf["id"]:
                states, steps = leaps(moves, n0, grid, int(run), tau, epsilon)
                for t, n in zip(grid, states, strict=True):
                    yield pd.DataFrame({"run": run, "t": t, "k": np.arange(moves.n), "n": n, "steps": steps})

    return _named(_runs(q.sparkSession, runs).mapInPandas(simulate, "run long, t double, k int, n long, steps long"), names, q)


def _named(out: DataFrame, names: list[tuple], q: DataFrame) -> DataFrame:
    kinds = f"k int, mode {q.schema['mode'].dataType.simpleString()}, node {q.schema['i'].dataType.simpleString()}"
    labels = q.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(names)], kinds)
    return out.join(F.broadcast(labels), "k").drop("k")


def against_mean(runs: DataFrame, law: DataFrame) -> DataFrame:
    """Ensemble mean and deviation beside the law (mode, node, n), with the z-score and the relative L1 distance of the whole.

    Runs that stopped before the horizon (not `complete`) are an error: they have no place beside the law there.
    """
    if "complete" in runs.columns:
        stopped = F.raise_error(F.concat(F.lit("run "), F.col("run").cast("string"), F.lit(" stopped before the horizon"))).cast("long")
        runs = runs.withColumn("n", F.when(F.col("complete"), F.col("n")).otherwise(stopped))
    own = runs.groupBy("mode", "node").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count(F.lit(1)).alias("runs"))
    own = cut(own)  # both uses below would run the simulation
    joined = own.join(law.withColumnRenamed("n", "expected"), ["mode", "node"])
    total = joined.agg((F.sum(F.abs(F.col("mean") - F.col("expected"))) / F.sum("expected")).alias("relative_l1"))
    z = F.try_divide(F.col("mean") - F.col("expected"), F.col("sd") / F.sqrt("runs"))
    return joined.withColumn("z", z).crossJoin(F.broadcast(total))

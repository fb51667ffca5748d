"""Markov chains on edges: transition kernels, generators, stationary and transient laws.

A chain is long-form rows (mode, i, j, p). Vector-matrix products are a join and a sum; the loops are lazy, with cuts.
For graphs of up to a few thousand nodes the spectral quantities come from NumPy, a task for each mode or removed node.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.fixpoint import cut, rounds, shared_folder, until_stable

#: Default sensitivity to cost (per second).
LAMBDA = 1 / 300


def kernel(edges: DataFrame, lam: float = LAMBDA, cost: str = "cost") -> DataFrame:
    """Softmax over each node's edges, shifted by the largest exponent; lam may be a whole number as well."""
    w = Window.partitionBy("mode", "i")
    weight = F.exp(-F.lit(float(lam)) * (F.col(cost) - F.min(cost).over(w)))
    return edges.select("mode", "i", "j", weight.alias("__w")).select("mode", "i", "j", (F.col("__w") / F.sum("__w").over(w)).alias("p")).filter("p > 0")


def generator(chain: DataFrame, rates: DataFrame) -> DataFrame:
    """(mode, i, j, q): mu_i p_ij off the diagonal, minus their sum on it; rates has (mode, i, mu). Zeros are left out."""
    off = chain.join(rates, ["mode", "i"]).select("mode", "i", "j", (F.col("mu") * F.col("p")).alias("q")).filter("q <> 0 and i <> j")
    diagonal = off.groupBy("mode", "i").agg((-F.sum("q")).alias("q")).select("mode", "i", F.col("i").alias("j"), "q")
    return off.unionByName(diagonal)


def validate(q: DataFrame, chain: DataFrame) -> DataFrame:
    """Row-sum errors, least rate off the diagonal, absorbing nodes and stored entries of each mode."""
    rows = q.groupBy("mode", "i").agg(F.sum("q").alias("s"), F.count(F.lit(1)).alias("k"))
    a = rows.groupBy("mode").agg(F.max(F.abs("s")).alias("row_error"), F.sum("k").alias("stored"))
    b = q.filter("i <> j").groupBy("mode").agg(F.min("q").alias("least_rate"))
    c = chain.groupBy("mode", "i").agg(F.sum("p").alias("s")).groupBy("mode").agg(F.max(F.abs(F.col("s") - 1)).alias("kernel_error"))
    ends = chain.select("mode", F.col("j").alias("node")).distinct().join(chain.select("mode", F.col("i").alias("node")).distinct(), ["mode", "node"], "left_anti")
    d = ends.groupBy("mode").agg(F.count(F.lit(1)).alias("absorbing"))
    return a.join(b, "mode").join(c, "mode").join(d, "mode", "left").withColumn("absorbing", F.coalesce("absorbing", F.lit(0)))


def assert_valid(q: DataFrame, chain: DataFrame, tolerance: float = 1e-8) -> None:
    bad = validate(q, chain).filter((F.col("row_error") > tolerance) | (F.col("kernel_error") > tolerance) | (F.col("least_rate") < 0)).head(1)
    assert not bad, f"not a generator: {bad}"


def nodes_of(chain: DataFrame) -> DataFrame:
    return chain.select("mode", F.col("i").alias("node")).union(chain.select("mode", F.col("j").alias("node"))).distinct()


def closed(chain: DataFrame) -> DataFrame:
    """Nodes without edges stay where they are."""
    ends = nodes_of(chain).join(chain.select("mode", F.col("i").alias("node")).distinct(), ["mode", "node"], "left_anti")
    return chain.unionByName(ends.select("mode", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("p")))


def step(x: DataFrame, chain: DataFrame) -> DataFrame:
    """x P for x (mode, node, v)."""
    by_source = chain.select("mode", F.col("i").alias("node"), F.col("j").alias("__to"), "p")
    return x.join(by_source, ["mode", "node"]).groupBy("mode", F.col("__to").alias("node")).agg(F.sum(F.col("v") * F.col("p")).alias("v"))


def with_markers(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mode, node, __to, p, own): the chain's moves, and a row from each node to itself that only carries what it has so far.

    With it a round reads the state once; reading it twice would double the plan each round.
    """
    moves = chain.select("mode", F.col("i").alias("node"), F.col("j").alias("__to"), "p", F.lit(False).alias("own"))
    return moves.unionByName(nodes.select("mode", "node", F.col("node").alias("__to"), F.lit(0.0).alias("p"), F.lit(True).alias("own")))


def stationary(chain: DataFrame, n_rounds: int | None = None, tolerance: float = 1e-10) -> DataFrame:
    """Cesàro mean of the laws from the uniform one, (mode, node, pi): after n_rounds, or until the mean moves less than the tolerance."""
    chain = cut(closed(cut(chain)))
    nodes = nodes_of(chain)
    moves = cut(with_markers(chain, nodes))
    start = nodes.select("mode", "node", (1 / F.count(F.lit(1)).over(Window.partitionBy("mode"))).alias("v")).select("*", F.col("v").alias("total"), F.lit(0).alias("k"))

    def one(x: DataFrame) -> DataFrame:
        moved = x.join(moves, ["mode", "node"]).groupBy("mode", F.col("__to").alias("node")).agg(F.sum(F.col("v") * F.col("p")).alias("v"), F.sum(F.when(F.col("own"), F.col("total"))).alias("total"), (F.max("k") + 1).alias("k"))
        return moved.withColumn("total", F.col("total") + F.col("v"))

    if n_rounds is not None:
        out = rounds(start, one, n_rounds, every=10)
    else:
        mean = lambda x: F.col(f"{x}.total") / (F.col(f"{x}.k") + 1)
        moved = lambda old, new: old.alias("a").join(new.alias("b"), ["mode", "node"]).filter((F.col("b.k") < 100) | (F.abs(mean("a") - mean("b")) > tolerance))
        out = until_stable(start, one, moved, every=10)
    return out.select("mode", "node", (F.col("total") / (F.col("k") + 1)).alias("pi"))


def departure_flux(pi: DataFrame, rates: DataFrame) -> DataFrame:
    """Departures of each node: pi over the sum of pi / mu; 0 where mu is 0."""
    w = Window.partitionBy("mode")
    joined = pi.join(rates.withColumnRenamed("i", "node"), ["mode", "node"], "left")
    held = F.sum(F.when(F.col("mu") > 0, F.col("pi") / F.col("mu"))).over(w)
    return joined.select("mode", "node", F.when(F.col("mu") > 0, F.coalesce(F.try_divide(F.col("pi"), held), F.lit(0.0))).otherwise(0.0).alias("flux"))


def entropy(chain: DataFrame) -> DataFrame:
    """Mean over nodes of the entropy of where they go."""
    row = chain.groupBy("mode", "i").agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p"))).alias("h"))
    return row.groupBy("mode").agg(F.avg("h").alias("entropy"))


def entropy_sweep(edges: DataFrame, lams: list[float]) -> DataFrame:
    """entropy() for each sensitivity: one plan, the sensitivities as a part of the mode."""
    grid = edges.withColumn("lam", F.explode(F.array(*map(F.lit, lams))))
    w = Window.partitionBy("lam", "mode", "i")
    p = grid.select("lam", "mode", "i", F.exp(-F.col("lam") * (F.col("cost") - F.min("cost").over(w))).alias("__w")).select("lam", "mode", "i", (F.col("__w") / F.sum("__w").over(w)).alias("p"))
    row = p.groupBy("lam", "mode", "i").agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p"))).alias("h"))
    return row.groupBy("lam", "mode").agg(F.avg("h").alias("entropy"))


def allocate(population: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each stop's people in even parts over the modes that serve it; nodes (mode, node), population (node, n)."""
    served = nodes.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("node")))
    return served.join(population, "node", "left").select("mode", "node", (F.coalesce("n", F.lit(0.0)) / F.col("__k")).alias("n"))


#: Largest rate times time of one series: e to the minus that is far from underflow.
SERIES = 200.0
#: Entries up to which the matrix is squared instead (one mode of 250 nodes, and where people go that leave); it is broadcast.
MOST_SQUARED = 251**2
#: Products of entries for a task.
TASK_PRODUCTS = 500_000
#: Rate times time of the step that is squared, and the terms of its series: what they leave out is below 1e-17 of an entry.
SHORT, SHORT_TERMS = 1 / 64, 7


def transient(q: DataFrame, start: DataFrame, t: float, terms: int | None = None, conserve: bool = True, most_squared: int = MOST_SQUARED) -> DataFrame:
    """N(t) = N0 e^{Qt} by uniformization; start (mode, node, v). Nodes without rates stay where they are.

    terms: so many of one series. By default small chains square the matrix of a short step, which takes the logarithm of
    rate times time in rounds; larger ones take as many terms as leave out less than 1e-12, in steps of time that keep the
    first weight from underflow. conserve: what the series leaves out is scaled back in, so mass is kept.
    """
    start = cut(start.select("mode", "node", "v"))
    q = cut(_with_diagonal(q, start))
    if terms is None:
        sizes = q.filter("i = j").groupBy("mode").agg(F.max(-F.col("q")).alias("rate"), (F.count(F.lit(1)) + 1).cast("double").alias("n"))
        found = sizes.agg(F.max("rate"), F.sum(F.pow("n", F.lit(2.0))), F.sum(F.pow("n", F.lit(3.0)))).first()
        fastest, entries, products = (x or 0.0 for x in found)
        steps = max(1, math.ceil(fastest * t / SERIES))
        terms = terms_for(fastest * t / steps)
        halvings = max(0, math.ceil(math.log2(fastest * t / SHORT))) if fastest * t > 0 else 0
        if entries <= most_squared and SHORT_TERMS + halvings < steps * terms:
            return _squared(q, start, fastest, t / 2**halvings, halvings, 1 + int(products) // TASK_PRODUCTS)
        for _ in range(steps - 1):
            start = _series(q, start, t / steps, terms, conserve).withColumnRenamed("n", "v")
        return _series(q, start, t / steps, terms, conserve)
    return _series(q, start, t, terms, conserve)


def _with_diagonal(q: DataFrame, start: DataFrame) -> DataFrame:
    """q with a rate of 0 on the diagonal for nodes that have none."""
    nodes = nodes_of(q).union(start.select("mode", "node")).distinct()
    known = q.filter("i = j").select("mode", F.col("i").alias("node"))
    return q.unionByName(nodes.join(known, ["mode", "node"], "left_anti").select("mode", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("q")))


def _squared(q: DataFrame, start: DataFrame, rate: float, h: float, halvings: int, tasks: int) -> DataFrame:
    """N0 P^(2^halvings), P the matrix of the step h; its rows are dealt to so many tasks.

    What leaves a sub-generator goes to a node without a name, so rows add up to 1 and are kept there: rounding, which
    squares would double, neither loses nor adds mass. No entry is negative, so nothing cancels.
    """
    row = q.groupBy("mode", "i").agg(F.sum("q").alias("s"), F.max(F.abs("q")).alias("top"))
    nobody = F.lit(None).cast(q.schema["j"].dataType)
    leaves = row.filter(F.col("s") < -1e-12 * F.col("top")).select("mode", "i", nobody.alias("j"), (-F.col("s")).alias("q"))
    gone = q.select("mode", nobody.alias("i"), nobody.alias("j"), F.lit(0.0).alias("q")).distinct()
    jump = q.unionByName(leaves).unionByName(gone).select("mode", "i", "j", (F.when(F.col("i").eqNullSafe(F.col("j")), 1.0).otherwise(0.0) + F.col("q") / rate).alias("p"))
    folder = f"{shared_folder(q.sparkSession).rstrip('/')}/squared-{uuid.uuid4().hex}"

    def table(x: DataFrame, name: str) -> DataFrame:
        """A table and not a checkpoint: that would keep the estimate of its size, which squares from round to round."""
        x.write.parquet(f"{folder}/{name}")
        return q.sparkSession.read.schema(x.schema).parquet(f"{folder}/{name}").repartition(tasks, "mode", "i")

    jump = table(jump.repartition(tasks, "mode", "i"), "jump")
    w = Window.partitionBy("mode", "i")

    def times(x: DataFrame, y: DataFrame) -> DataFrame:
        """x y; a row of the result is made where the row of x is."""
        right = y.select(F.col("mode").alias("__mode"), F.col("i").alias("__via"), F.col("j").alias("__to"), F.col("p").alias("__p"))
        both = x.join(F.broadcast(right), (F.col("mode") == F.col("__mode")) & F.col("j").eqNullSafe(F.col("__via")))
        return both.groupBy("mode", "i", F.col("__to").alias("j")).agg(F.sum(F.col("p") * F.col("__p")).alias("p"))

    kept = lambda x: x.select("mode", "i", "j", (F.col("p") / F.sum("p").over(w)).alias("p"))
    # 1 + aJ/1 (1 + aJ/2 (1 + ...)) from inside; the entry on the diagonal is always there
    begin = lambda x, k: x.select("mode", "i", "j", (F.col("p") * rate * h / k + F.when(F.col("i").eqNullSafe(F.col("j")), 1.0).otherwise(0.0)).alias("p"))
    power = begin(jump, SHORT_TERMS)
    for k in range(SHORT_TERMS - 1, 0, -1):
        power = begin(times(power, jump), k)
    power = table(kept(power), "0")
    for k in range(1, halvings + 1):
        power = table(kept(times(power, power)), str(k))
    moves = power.filter("j is not null").select("mode", F.col("i").alias("node"), F.col("j").alias("__to"), "p")
    return start.join(moves, ["mode", "node"]).groupBy("mode", F.col("__to").alias("node")).agg(F.sum(F.col("v") * F.col("p")).alias("n"))


def _series(q: DataFrame, start: DataFrame, t: float, terms: int, conserve: bool) -> DataFrame:
    top = q.filter("i = j").groupBy("mode").agg(F.max(-F.col("q")).alias("rate"))  # a row for each mode
    top = top.withColumn("rate", F.when(F.col("rate") > 0, F.col("rate")).otherwise(1.0))
    jump = q.join(F.broadcast(top), "mode").select("mode", "i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) + F.col("q") / F.col("rate")).alias("p"))
    begin = start.join(F.broadcast(top), "mode").select("mode", "node", "v", (F.col("v") * F.exp(-F.col("rate") * t)).alias("out"), F.exp(-F.col("rate") * t).alias("weight"), F.exp(-F.col("rate") * t).alias("used"), "rate", F.lit(0).alias("k"))

    moves = cut(with_markers(jump, nodes_of(jump)))

    def one(x: DataFrame) -> DataFrame:
        factor = F.col("weight") * F.col("rate") * t / (F.col("k") + 1)
        moved = x.withColumn("weight", factor).join(moves, ["mode", "node"]).groupBy("mode", F.col("__to").alias("node")).agg(
            F.sum(F.col("v") * F.col("p")).alias("v"), F.sum(F.when(F.col("own"), F.col("out"))).alias("out"),
            *(F.max(c).alias(c) for c in ("weight", "used", "rate", "k")),
        )
        return moved.select("mode", "node", "v", (F.coalesce("out", F.lit(0.0)) + F.col("weight") * F.col("v")).alias("out"), "weight", (F.col("used") + F.col("weight")).alias("used"), "rate", (F.col("k") + 1).alias("k"))

    return rounds(begin, one, terms, every=10).select("mode", "node", (F.col("out") / (F.col("used") if conserve else F.lit(1.0))).alias("n"))


def terms_for(rate_time: float, tolerance: float = 1e-12) -> int:
    """Terms after which the rest of the Poisson weights is below the tolerance."""
    k, weight, total = 0, math.exp(-rate_time), math.exp(-rate_time)
    while 1 - total > tolerance and k < 10_000:
        k += 1
        weight *= rate_time / k
        total += weight
    return k


def transient_grid(q: DataFrame, start: DataFrame, times: Sequence[float], conserve: bool = True) -> DataFrame:
    """(t, mode, node, n): N(t) at times that go up, each going on from the one before."""
    if any(t < 0 for t in times) or list(times) != sorted(times):
        raise ValueError("times must go up from 0")
    q, now, before, out = cut(q), cut(start.select("mode", "node", "v")), 0.0, None
    for t in times:
        if t > before:
            now, before = cut(transient(q, now, t - before, conserve=conserve).withColumnRenamed("n", "v")), t
        rows = now.select(F.lit(float(t)).alias("t"), "mode", "node", F.col("v").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def conservation_error(start: DataFrame, end: DataFrame, a: str = "v", b: str = "n") -> DataFrame:
    """|sum at the end - sum at the start| / sum at the start."""
    return start.agg(F.sum(a).alias("__a")).crossJoin(end.agg(F.sum(b).alias("__b"))).select((F.abs(F.col("__b") - F.col("__a")) / F.col("__a")).alias("error"))


def largest_leap(state: DataFrame, rates: DataFrame, tau: float, epsilon: float) -> DataFrame:
    """min(tau, epsilon over the largest rate of a node with people)."""
    busy = state.filter("n > 0").join(rates.withColumnRenamed("i", "node"), ["mode", "node"])
    return busy.agg(F.least(F.lit(float(tau)), F.coalesce(F.try_divide(F.lit(float(epsilon)), F.max("mu")), F.lit(float(tau)))).alias("leap"))


def jump_chain(rates: DataFrame) -> DataFrame:
    """Embedded jump chain of rates (src, dst, rate), dst 'exit' included: (src, dst, p, hold), hold the total rate."""
    w = Window.partitionBy("src")
    return rates.select("src", "dst", (F.col("rate") / F.sum("rate").over(w)).alias("p"), F.sum("rate").over(w).alias("hold"))


# Dense parts: one task for each group


def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, list]:
    names = sorted(set(pdf.i) | set(pdf.j))
    at = {x: k for k, x in enumerate(names)}
    p = np.zeros((len(names), len(names)))
    np.add.at(p, ([at[x] for x in pdf.i], [at[x] for x in pdf.j]), pdf.p.to_numpy(float))
    return p, names


def stochastic(p: np.ndarray) -> np.ndarray:
    """Rows scaled to 1; empty rows stay where they are."""
    p, s = p.copy(), p.sum(1)
    empty = s <= 0
    p[~empty] /= s[~empty, None]
    p[empty, np.flatnonzero(empty)] = 1
    return p


def reachable(adjacent: np.ndarray, start: int = 0) -> np.ndarray:
    seen = np.zeros(len(adjacent), bool)
    seen[start], front = True, np.array([start])
    while len(front):
        new = adjacent[front].any(0) & ~seen
        seen |= new
        front = np.flatnonzero(new)
    return seen


def irreducible(p: np.ndarray) -> bool:
    if len(p) <= 1:
        return True
    a = p > 0
    return bool(reachable(a).all() and reachable(a.T).all())


#: Nodes up to which the whole spectrum is made; beyond it the largest eigenvalues by Arnoldi's method.
DENSE, KRYLOV = 1500, 60


def largest(p: np.ndarray, k: int = KRYLOV, restarts: int = 3) -> np.ndarray:
    """The k eigenvalues of largest modulus, about: those of the projection on a Krylov space four times as large."""
    n, m = len(p), min(len(p) - 1, 4 * k)
    start = np.random.default_rng(3).standard_normal(n)
    for _ in range(restarts):
        basis, h = np.zeros((m + 1, n)), np.zeros((m + 1, m))
        basis[0] = start / np.linalg.norm(start)
        size = m
        for j in range(m):
            w = basis[j] @ p
            for _ in range(2):  # twice is enough for orthogonality
                part = basis[: j + 1] @ w
                w = w - part @ basis[: j + 1]
                h[: j + 1, j] += part
            h[j + 1, j] = np.linalg.norm(w)
            if h[j + 1, j] < 1e-12:
                size = j + 1
                break
            basis[j + 1] = w / h[j + 1, j]
        values, vectors = np.linalg.eig(h[:size, :size])
        order = np.argsort(-np.abs(values))
        start = np.real(basis[:size].T @ vectors[:, order[:k]].sum(1))
    return values[order[:k]]


def spectrum(p: np.ndarray, dense: int = DENSE) -> np.ndarray:
    """Eigenvalues but the principal one, all or the largest; those beyond the unit circle are rounding errors."""
    values = np.linalg.eigvals(p) if len(p) <= dense else largest(p)
    values = values[np.abs(values) <= 1 + 1e-7]
    return np.delete(values, np.argmin(np.abs(values - 1))) if len(values) else values


def kemeny(p: np.ndarray, values: np.ndarray | None = None) -> float:
    """Expected steps to a stationary target; NaN if the chain is reducible, the node count if it has no eigenvalues left. Eigenvalues that aren't known count as 0."""
    if not irreducible(p):
        return float("nan")
    values = spectrum(p) if values is None else values
    return float(np.real(np.sum(1 / (1 - values)))) + max(0, len(p) - 1 - len(values)) if len(values) else float(len(p))


def gap(p: np.ndarray, values: np.ndarray | None = None) -> float:
    values = spectrum(p) if values is None else values
    return float(1 - np.abs(values).max()) if len(values) else 1.0


def hop_efficiency(p: np.ndarray) -> float:
    """Mean of 1 / hops over ordered pairs; 1 for a single node."""
    n = len(p)
    if n <= 1:
        return 1.0
    adjacent, total = p > 0, 0.0
    np.fill_diagonal(adjacent, False)
    seen = np.eye(n, dtype=bool)
    front, d = seen.copy(), 0
    while front.any():
        d += 1
        front = ((front.astype(np.float32) @ adjacent.astype(np.float32)) > 0) & ~seen
        total += front.sum() / d
        seen |= front
    return total / (n * (n - 1))


def without(p: np.ndarray, k: int) -> np.ndarray:
    keep = np.arange(len(p)) != k
    return stochastic(p[np.ix_(keep, keep)])


def diagnostics(chain: DataFrame) -> DataFrame:
    """Kemeny constant, spectral gap, efficiency, irreducible and periodic (an eigenvalue of -1) of each mode."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, names = dense(pdf)
        p = stochastic(p)
        values = spectrum(p)
        return pd.DataFrame([{"mode": pdf["mode"].iloc[0], "nodes": len(names), "kemeny": kemeny(p, values), "gap": gap(p, values), "efficiency": hop_efficiency(p), "irreducible": irreducible(p), "periodic": bool(len(values) and np.abs(values + 1).min() < 1e-8)}])

    return chain.select("mode", "i", "j", "p").groupBy("mode").applyInPandas(one, f"mode {chain.schema['mode'].dataType.simpleString()}, nodes long, kemeny double, gap double, efficiency double, irreducible boolean, periodic boolean")


def drops(p: np.ndarray, k: int, base: tuple[float, float, float]) -> tuple[float, float, float, float]:
    """(kemeny, gap, efficiency, vulnerability) of removing node k, each relative and not below 0; kemeny 1 if irreducibility is lost."""
    k0, g0, e0 = base
    rest = without(p, k)
    values = spectrum(rest)
    after = kemeny(rest, values)
    if math.isnan(after):
        dk = 0.0 if math.isnan(k0) else 1.0
    else:
        dk = 0.0 if math.isnan(k0) or k0 == 0 else max(0.0, (after - k0) / abs(k0))
    dg = max(0.0, (g0 - gap(rest, values)) / g0) if g0 > 0 else 0.0
    de = max(0.0, (e0 - hop_efficiency(rest)) / e0) if e0 > 0 else 0.0
    return dk, dg, de, (dk + dg + de) / 3


#: Entries of chains that removals() sends to all tasks.
MOST_ENTRIES = 5_000_000


def removals(chain: DataFrame, top: DataFrame | None = None, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Vulnerability of each (mode, node): removed nodes are dealt to tasks, which have the chains (their size is checked) and what they are like whole. top: (mode, node) to look at, else all."""
    spark, kinds = chain.sparkSession, {c: chain.schema[c].dataType.simpleString() for c in ("mode", "i")}
    chain = cut(chain.select("mode", "i", "j", "p"))
    if (n := chain.count()) > most_entries:
        raise ValueError(f"{n} entries are more than most_entries")
    shared = spark.sparkContext.broadcast(chain.toPandas())
    wanted = (top if top is not None else nodes_of(chain)).select("mode", F.col("node").alias("removed"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict = {}
        for pdf in batches:
            rows = []
            for mode, gone in zip(pdf["mode"], pdf["removed"], strict=True):
                if mode not in whole:
                    p, names = dense(shared.value[shared.value["mode"] == mode])
                    p = stochastic(p)
                    values = spectrum(p)
                    whole = {mode: (p, names, (kemeny(p, values), gap(p, values), hop_efficiency(p)))}
                p, names, base = whole[mode]
                rows.append((mode, gone, *drops(p, names.index(gone), base)))
            yield pd.DataFrame(rows, columns=["mode", "node", "d_kemeny", "d_gap", "d_efficiency", "vulnerability"])

    dealt = wanted.repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("mode")
    return dealt.mapInPandas(one, f"mode {kinds['mode']}, node {kinds['i']}, d_kemeny double, d_gap double, d_efficiency double, vulnerability double")

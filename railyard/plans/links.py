"""New links by the risk they leave: each failed node is a task, which scores all links tried.

A task gets the pairs whose ways go through its node (graph.failures()) and makes the node's matrix from the broadcast intact
one. A link a-b of cost c can only shorten ways from origins with t(o, a) + c < t(o, b) to destinations with
t(b, d) + c < t(a, d), or the other way round: only that part of a matrix is looked at. Tasks give (link, node, v); mean and
maximum over nodes are an aggregation. What is broadcast, and what a task holds, are matrices of `MOST` nodes at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of the matrices that are broadcast (two of 72 MB).
MOST = 3000

Link = tuple[int, int, float]


def shortened(t: np.ndarray, link: Link) -> Iterator[tuple[tuple, np.ndarray]]:
    """(places, new times) of the parts of a matrix in which the link can shorten a way; no pair is in both."""
    c = link[2]
    for a, b in (link[:2], link[1::-1]):
        rows = (t[:, a] + c < t[:, b]).nonzero()[0]
        if len(rows) and len(columns := (t[b] + c < t[a]).nonzero()[0]):
            at = rows[:, None], columns
            yield at, np.minimum(t[at], (t[rows, a] + c)[:, None] + t[b, columns])


def with_link(t: np.ndarray, link: Link) -> np.ndarray:
    out = t.copy()
    for at, new in shortened(t, link):
        out[at] = new
    return out


def values(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w / t, 0 where there is no time."""
    return np.divide(w, t, out=np.zeros_like(w), where=t > 0)


def gain(t: np.ndarray, w: np.ndarray, now: np.ndarray, link: Link) -> float:
    """What the link adds to the sum of values(t, w), which are `now`."""
    total = 0.0
    for at, new in shortened(t, link):
        total += values(new, w[at]).sum() - now[at].sum()
    return float(total)


class Node:
    """One node's failure: the intact matrix and that without the node, over the pairs that don't touch it."""

    def __init__(self, k: int, t: np.ndarray, without: np.ndarray, w: np.ndarray):
        w = w.copy()
        w[k], w[:, k] = 0, 0
        self.k, self.t, self.m, self.w = k, t, without, w
        self.now, self.then = values(t, w), values(without, w)
        self.before, self.after = float(self.now.sum()), float(self.then.sum())

    def given(self, link: Link) -> Node:
        """With the link there; one of the failed node goes with it."""
        return Node(self.k, with_link(self.t, link), self.m if self.k in link[:2] else with_link(self.m, link), self.w)

    def v(self, link: Link) -> float:
        before = self.before + gain(self.t, self.w, self.now, link)
        after = self.after + (0.0 if self.k in link[:2] else gain(self.m, self.w, self.then, link))
        return 1 - after / before if before > 0 else 1.0


@dataclass
class Scorer:
    """Intact times t and weights w between the named nodes, what failures change (removed, source, node, t), and the nodes (node) that may fail."""

    names: list
    t: np.ndarray
    w: np.ndarray
    changes: DataFrame
    nodes: DataFrame
    alpha: float = 0.5

    def __post_init__(self):
        if len(self.names) > MOST:
            raise ValueError(f"{len(self.names)} nodes are more than {MOST}")
        w = np.array(self.w, float)
        np.fill_diagonal(w, 0)
        self.w = w / w.sum()
        self.shared = self.nodes.sparkSession.sparkContext.broadcast((self.t, self.w, {x: k for k, x in enumerate(self.names)}))

    def _scored(self, links: Sequence[Link], fixed: Sequence[Link], pairs: bool) -> DataFrame:
        """(m, n, j) of links, or of all pairs of them, together with the fixed ones."""
        shared, links, fixed = self.shared, list(links), list(fixed)

        def one(node: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            t, w, at = shared.value
            k = at[node["node"].iloc[0]]
            m = t.copy()
            m[k], m[:, k] = np.inf, np.inf
            m[changes["source"].map(at).to_numpy(int), changes["node"].map(at).to_numpy(int)] = changes["t"].fillna(np.inf).to_numpy(float)
            own = Node(k, t, m, w)
            for link in fixed:
                own = own.given(link)
            if not pairs:
                return pd.DataFrame({"m": np.arange(len(links)), "n": -1, "v": [own.v(x) for x in links]}, columns=["m", "n", "v"])
            out = []
            for a, first in enumerate(links):
                with_first = own.given(first) if a + 1 < len(links) else own
                out.append(pd.DataFrame({"m": a, "n": np.arange(a + 1, len(links)), "v": [with_first.v(x) for x in links[a + 1 :]]}, columns=["m", "n", "v"]))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"m": np.zeros(0, int), "n": np.zeros(0, int), "v": np.zeros(0)})

        # a count of partitions that is given: adaptive execution would gather these few rows, which are a lot of work, in one task
        parts = 4 * self.nodes.sparkSession.sparkContext.defaultParallelism
        changes = self.changes.select("removed", "source", F.col("node").alias("node"), "t").repartition(parts, "removed")
        rows = self.nodes.select("node").distinct().repartition(parts, "node").groupBy("node").cogroup(changes.groupBy("removed"))
        return rows.applyInPandas(one, "m long, n long, v double").groupBy("m", "n").agg((self.alpha * F.avg("v") + (1 - self.alpha) * F.max("v")).alias("j"))

    def singles(self, links: Sequence[Link], fixed: Sequence[Link] = ()) -> DataFrame:
        """(id, j): the risk with each link, by its place in the list."""
        return self._scored(links, fixed, pairs=False).select(F.col("m").alias("id"), "j")

    def pairs(self, links: Sequence[Link]) -> DataFrame:
        """(m, n, j): the risk with each pair of links."""
        return self._scored(links, (), pairs=True)

    def best(self, links: Sequence[Link], budget: int) -> list[tuple[Link, float]]:
        """The links that lower the risk most, one after the other, with the risk after each (of equals the first in the list). A job for each; the driver gets its best row."""
        out, left = [], list(range(len(links)))
        while left and len(out) < budget:
            found = self.singles([links[x] for x in left], [x for x, _ in out]).orderBy("j", "id").first()
            out.append((links[left.pop(found["id"])], found["j"]))
        return out

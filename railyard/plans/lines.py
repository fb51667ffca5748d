"""New lines by what they add to the efficiency of a network.

Who takes a line waits half a headway at a stop, rides, and goes on from any later stop. Along the line the soonest time on
board is carried from stop to stop, so a line of k stops costs k passes over the matrix of times. Candidates are scored in
tasks that share the matrix, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.fixpoint import cut
from railyard.plans.scenario import MOST_NODES


def with_line(t: np.ndarray, stops: Sequence[int], rides: Sequence[float], headway: float, one_way: bool = False) -> np.ndarray:
    """Times with a line through the stops, `rides` from each to the next; both ways unless one_way."""
    out = t.copy()
    for way, legs in ((stops, rides),) if one_way else ((stops, rides), (stops[::-1], rides[::-1])):
        aboard = np.full(len(t), np.inf)
        for here, there, ride in zip(way, way[1:], legs, strict=False):
            aboard = np.minimum(aboard, t[:, here] + headway / 2) + ride
            np.minimum(out, aboard[:, None] + t[there], out=out)
    return out


@dataclass(frozen=True)
class Network:
    """Times (n, n), inf where there is no way and 0 on the diagonal, and weights of pairs (n, n)."""

    t: np.ndarray
    w: np.ndarray

    def __post_init__(self):
        if len(self.t) > MOST_NODES:
            raise ValueError(f"{len(self.t)} nodes are more than {MOST_NODES}")

    def efficiency(self) -> float:
        part = np.isfinite(self.t) & (self.t > 0)
        return float((self.w[part] / self.t[part]).sum() / (self.w.sum() - np.trace(self.w)))

    def given(self, stops: Sequence[int], rides: Sequence[float], headway: float) -> Network:
        return Network(with_line(self.t, stops, rides, headway), self.w)


def gains(own: Network, candidates: DataFrame, unit: float | None = None) -> DataFrame:
    """(id, gain) of candidates (id, stations array<int>, seconds array<double>, headway double): what each adds to the efficiency, in units of it (or of the given one)."""
    now = own.efficiency()
    shared, unit = candidates.sparkSession.sparkContext.broadcast(own), unit or now

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shared.value.given(list(s), list(r), h).efficiency() for s, r, h in zip(pdf["stations"], pdf["seconds"], pdf["headway"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "gain": [(e - now) / unit for e in found]})

    return candidates.select("id", "stations", "seconds", "headway").mapInPandas(score, "id long, gain double")


def best_lines(own: Network, candidates: DataFrame, k: int, at_once: int = 32) -> list[dict]:
    """The k lines of most gain for their price, one after the other: [{step, id, marginal, total}], gains in units of the first efficiency.

    candidates: (id, stations, seconds, headway, price[, key]); of those with one key only one is taken. Gains shrink as lines
    are added, so an old gain is a bound: each round looks at the best `at_once` by what is known, renews those whose gain is
    old in one job, and takes the first one if its gain is new. The driver sees these few rows and the matrix.
    """
    key = F.col("key") if "key" in candidates.columns else F.col("id")
    rows = cut(candidates.withColumn("key", key))
    first, steps, used = own.efficiency(), [], []
    known = cut(gains(own, rows).join(rows.select("id", "key", "price"), "id").withColumn("step", F.lit(0)))
    while len(steps) < k:
        top = known.filter(~F.col("key").isin(used)).orderBy(F.desc(F.col("gain") / F.col("price")), "id").limit(at_once).collect()
        if not top:
            break
        if top[0]["step"] == len(steps):
            line = rows.filter(F.col("id") == top[0]["id"]).first()
            own = own.given(line["stations"], line["seconds"], line["headway"])
            used.append(top[0]["key"])
            steps.append({"step": len(steps), "id": top[0]["id"], "marginal": top[0]["gain"], "total": (own.efficiency() - first) / first})
            continue
        old = [r["id"] for r in top if r["step"] < len(steps)]
        new = gains(own, rows.filter(F.col("id").isin(old)), first).select("id", F.col("gain").alias("renewed"))
        step = F.when(F.col("renewed").isNotNull(), F.lit(len(steps))).otherwise(F.col("step"))
        known = cut(known.join(new, "id", "left").select("id", F.coalesce("renewed", "gain").alias("gain"), "key", "price", step.alias("step")))
    return steps

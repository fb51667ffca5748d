"""Balance of a chain with an exit, by eliminating blocks of states in tasks.

The states of a line's segments only meet other states at hubs. So each block (a line, say) is eliminated in a task of its
own: with P the chance of a jump, N = (I - P_bb)^-1 is what a block makes of what enters it, and E N X (entries, N, exits) is
the chance that who enters it from a state outside comes out at another. What is left is a smaller chain on the rest, which
is summed over its steps by joins: who goes round in it has changed lines each time, so a step keeps the share of transfers
at most. Then each block is filled in from its entries, in a task again. The elimination is made once and serves many right
sides, told apart by key columns.

A block has at most about `most` states: larger ones are cut, and states that are entered from another piece join the rest.
No task holds more than a block with its entries and exits, and the way is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.fixpoint import cut, until_stable
from railyard.plans import chain

#: States of a block, about (a matrix of 32 MB).
MOST = 2000
EXIT = "exit"


def stepped(x: DataFrame, moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One step of a chain for (keys, state, y, total); moves has a marker from each state to itself that carries its total."""
    moved = x.join(moves, "state").groupBy(*keys, F.col("__to").alias("state")).agg(F.sum(F.col("y") * F.col("p")).alias("y"), F.sum(F.when(F.col("own"), F.col("total"))).alias("total"))
    return moved.withColumn("total", F.coalesce("total", F.lit(0.0)) + F.col("y"))


def marked(moves: DataFrame, states: DataFrame) -> DataFrame:
    """(state, __to, p) with markers for stepped()."""
    return moves.select("state", "__to", "p", F.lit(False).alias("own")).unionByName(states.select("state", F.col("state").alias("__to"), F.lit(0.0).alias("p"), F.lit(True).alias("own")))


def _inner(edges: pd.DataFrame) -> tuple[dict, np.ndarray]:
    """Places of a block's states, and (I - P)'. A column of it has its largest number on the diagonal, so solving neither swaps rows nor takes like numbers off each other, and states that can't be reached get a plain 0."""
    own = edges[edges.kind == "state"]
    at = {x: k for k, x in enumerate(sorted(own.src))}
    m = np.eye(len(at))
    inner = edges[edges.kind == "inner"]
    np.subtract.at(m, (inner.dst.map(at).to_numpy(int), inner.src.map(at).to_numpy(int)), inner.p.to_numpy())
    return at, m


def _pass_through(edges: pd.DataFrame) -> pd.DataFrame:
    """(state, __to, p) of a block: from where it is entered to where one comes out."""
    entries, exits = edges[edges.kind == "entry"], edges[edges.kind == "exit"]
    if not len(entries) or not len(exits):
        return pd.DataFrame({"state": np.array([], object), "__to": np.array([], object), "p": np.zeros(0)})
    at, m = _inner(edges)
    sources, targets = (sorted(set(x)) for x in (entries.src, exits.dst))
    enter, leave = np.zeros((len(sources), len(at))), np.zeros((len(at), len(targets)))
    np.add.at(enter, (entries.src.map({x: k for k, x in enumerate(sources)}), entries.dst.map(at)), entries.p)
    np.add.at(leave, (exits.src.map(at), exits.dst.map({x: k for k, x in enumerate(targets)})), exits.p)
    r = np.linalg.solve(m, enter.T).T @ leave
    a, b = np.nonzero(r > 0)
    return pd.DataFrame({"state": np.array(sources, object)[a], "__to": np.array(targets, object)[b], "p": r[a, b]})


class Reduced:
    """rates (src, dst, rate) with dst "exit" for leaving, and blocks (state, block) of the states to eliminate."""

    def __init__(self, rates: DataFrame, blocks: DataFrame, most: int = MOST):
        jumps = cut(chain.jump_chain(rates))
        self.hold = cut(jumps.select(F.col("src").alias("state"), "hold").distinct())
        moves = jumps.filter(F.col("dst") != EXIT).select("src", "dst", F.col("p").cast("double").alias("p"))
        states = self.hold.select("state").unionByName(moves.select(F.col("dst").alias("state"))).distinct()

        own = states.join(blocks.select("state", F.col("block").cast("string").alias("block")), "state")
        parts = own.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
        piece = F.when(F.col("parts") > 1, F.concat_ws("/", "block", F.pmod(F.xxhash64("state"), F.col("parts")))).otherwise(F.col("block"))
        own = cut(own.join(parts, "block").select("state", piece.alias("block")))
        of = lambda end: own.select(F.col("state").alias(end), F.col("block").alias(f"{end}_block"))
        told = cut(moves.join(of("src"), "src", "left").join(of("dst"), "dst", "left"))
        across = told.filter(F.col("src_block") != F.col("dst_block")).select(F.col("dst").alias("state")).distinct()
        inside = cut(own.join(across, "state", "left_anti"))

        at = lambda end: inside.select(F.col("state").alias(end), F.col("block").alias(f"{end}_block"))
        told = moves.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
        into, out = F.col("dst_block").isNotNull(), F.col("src_block").isNotNull()
        kind = F.when(into & out, "inner").when(into, "entry").when(out, "exit").otherwise("rest")
        told = cut(told.select("src", "dst", "p", kind.alias("kind"), F.coalesce("dst_block", "src_block").alias("block")))
        #: Jumps of blocks, and a row for each state inside.
        self.edges = cut(told.filter("kind <> 'rest'").unionByName(inside.select(F.col("state").alias("src"), F.col("state").alias("dst"), F.lit(1.0).alias("p"), F.lit("state").alias("kind"), "block")))
        self.inside = inside
        passed = self.edges.groupBy("block").applyInPandas(_pass_through, "state string, __to string, p double")
        rest = told.filter("kind = 'rest'").select(F.col("src").alias("state"), F.col("dst").alias("__to"), "p").unionByName(passed)
        #: The chain on the rest.
        self.rest = cut(rest.groupBy("state", "__to").agg(F.sum("p").alias("p")))
        self.outside = cut(states.join(inside, "state", "left_anti"))
        self._moves = cut(marked(self.rest, self.outside))

    def _filled(self, given: DataFrame, keys: Sequence[str], out: bool) -> DataFrame:
        """(keys, state, y): what blocks make of what enters them at (keys, state, y): visits of their states, or who comes out and where."""
        keys = list(keys)
        rows = given.join(self.inside, "state")
        kinds = "".join(f"{c} {given.schema[c].dataType.simpleString()}, " for c in keys)

        def one(edges: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
            if not len(entered):
                return pd.DataFrame({c: np.array([], object) for c in [*keys, "state"]} | {"y": np.zeros(0)})
            at, m = _inner(edges)
            groups = entered[keys].drop_duplicates().reset_index(drop=True) if keys else pd.DataFrame(index=[0])
            which = entered[keys].merge(groups.assign(__k=range(len(groups))), on=keys, how="left")["__k"].to_numpy() if keys else np.zeros(len(entered), int)
            right = np.zeros((len(at), len(groups)))
            np.add.at(right, (entered.state.map(at).to_numpy(int), which), entered.y.to_numpy())
            visits, names = np.linalg.solve(m, right), np.array(sorted(at), object)
            if out:
                exits = edges[edges.kind == "exit"]
                names, to = np.unique(exits.dst.to_numpy(object), return_inverse=True)
                leave = np.zeros((len(names), len(at)))
                np.add.at(leave, (to, exits.src.map(at).to_numpy(int)), exits.p.to_numpy())
                visits = leave @ visits
            a, b = np.nonzero(visits > 0)
            return pd.DataFrame({c: groups[c].to_numpy(object)[b] for c in keys} | {"state": names[a], "y": visits[a, b]})

        return self.edges.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(one, f"{kinds}state string, y double")

    def mass(self, source: DataFrame, keys: Sequence[str] = (), tolerance: float = 1e-12) -> DataFrame:
        """(keys, state, mass) with mass (-T) = source (keys, state, rate). States that nobody gets to have no row."""
        keys = list(keys)
        given = cut(source.filter("rate > 0").select(*keys, "state", F.col("rate").cast("double").alias("y")).groupBy(*keys, "state").agg(F.sum("y").alias("y")))
        inner = given.join(self.inside.select("state"), "state", "left_semi")
        start = given.join(self.inside.select("state"), "state", "left_anti")
        start = start.unionByName(self._filled(inner, keys, out=True)).groupBy(*keys, "state").agg(F.sum("y").alias("y"))
        scale = given.agg(F.max("y")).first()[0] or 1.0
        total = self._summed(start, self._moves, keys, tolerance * scale)
        entries = self.edges.filter("kind = 'entry'").select(F.col("src").alias("state"), F.col("dst").alias("__to"), "p")
        entered = total.join(entries, "state").select(*keys, F.col("__to").alias("state"), (F.col("y") * F.col("p")).alias("y")).unionByName(inner)
        visits = total.unionByName(self._filled(entered.groupBy(*keys, "state").agg(F.sum("y").alias("y")), keys, out=False))
        return visits.join(self.hold, "state").select(*keys, "state", (F.col("y") / F.col("hold")).alias("mass"))

    def worth(self, reward: DataFrame, keys: Sequence[str] = (), tolerance: float = 1e-12) -> DataFrame:
        """(keys, state, y): expected sum of reward (keys, state, y) over the visits of who starts in a state of the rest; rewards are for states of the rest."""
        back = self.rest.select(F.col("__to").alias("state"), F.col("state").alias("__to"), "p")
        return self._summed(reward.select(*keys, "state", "y"), cut(marked(back, self.outside)), list(keys), tolerance)

    @staticmethod
    def _summed(start: DataFrame, moves: DataFrame, keys: list[str], least: float) -> DataFrame:
        first = start.withColumn("total", F.col("y"))
        out = until_stable(first, lambda x: stepped(x, moves, keys), lambda old, new: new.filter(F.col("y") > least), every=6)
        return out.select(*keys, "state", F.col("total").alias("y"))


def residual(rates: DataFrame, mass: DataFrame, source: DataFrame) -> float:
    """Largest |mass (-T) - source| of a state, relative to the largest rate of the source."""
    moved = mass.withColumnRenamed("state", "src").join(rates, "src").withColumn("flow", F.col("mass") * F.col("rate"))
    out = moved.select(F.col("src").alias("state"), "flow").unionByName(moved.filter(F.col("dst") != EXIT).select(F.col("dst").alias("state"), (-F.col("flow")).alias("flow")))
    left = out.unionByName(source.select("state", (-F.col("rate")).alias("flow"))).groupBy("state").agg(F.abs(F.sum("flow")).alias("off"))
    return float((left.agg(F.max("off")).first()[0] or 0.0) / (source.agg(F.max("rate")).first()[0] or 1.0))

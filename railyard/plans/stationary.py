"""Long-run laws of chains of any size: what the mean of the laws of all steps tends to from the uniform law, also if the chain is periodic or falls into parts.

Strongly connected classes without a way out keep what gets into them: their weights are the uniform mass of their own nodes
and what transient nodes hand on, which is a balance with blocks (balance.Reduced, a block for each transient class). Within
a class the law is unique. Classes of at most `size` nodes are solved in a task each. Larger ones are worked out by
aggregation and disaggregation: nodes are put in blocks of about `size`, which follow the distance from one node, so that
most moves stay in a block or go to the next one. In each round
1. the chain of blocks at the present guess (aggregation) gives the weight of each block; it is solved in the same way;
2. each block is solved in a task for what flows into it from the others (disaggregation);
3. that is the new guess, or, where a round brought it hardly nearer, the mean of both, which settles classes that
   alternate between blocks.
No task holds more than a block, or a chain of at most `size` blocks.
"""

from __future__ import annotations

import logging
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.fixpoint import NotConverged, cut, shared_folder
from railyard.operators import graph
from railyard.plans import balance, chain

LOG = logging.getLogger(__name__)

#: Nodes of a block, about (a matrix of 8 MB).
SIZE = 1000


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(names, P) of rows (i, j, p)."""
    names, at = np.unique(np.concatenate([pdf["i"].to_numpy(object), pdf["j"].to_numpy(object)]), return_inverse=True)
    p = np.zeros((len(names), len(names)))
    np.add.at(p, (at[: len(pdf)], at[len(pdf) :]), pdf["p"].to_numpy())
    return names, p


def _direct(pdf: pd.DataFrame) -> pd.DataFrame:
    """The law of one small class: pi (I - P) = 0 with a sum of 1 in place of one equation."""
    names, p = _matrix(pdf)
    m = np.eye(len(p)) - (p / p.sum(1, keepdims=True)).T
    m[-1] = 1.0
    right = np.zeros(len(p))
    right[-1] = 1.0
    pi = np.maximum(np.linalg.solve(m, right), 0.0)
    return pd.DataFrame({"cls": pdf["cls"].iloc[0], "node": names, "pi": pi / pi.sum()})


def _block_of(moves: DataFrame, size: int) -> DataFrame:
    """(cls, node, block): levels of the distance from each class's smallest node, gathered up to the size; a level that is larger is cut by hash."""
    ends = moves.select(F.struct("cls", F.col("i").alias("x")).alias("i"), F.struct("cls", F.col("j").alias("x")).alias("j")).filter("i <> j")
    first = moves.groupBy("cls").agg(F.min("i").alias("x")).select(F.struct("cls", "x").alias("source"))
    far = cut(graph.hops(ends.unionByName(graph.backward(ends)), first).select(F.col("node.cls").alias("cls"), F.col("node.x").alias("node"), "d"))
    levels = far.groupBy("cls", "d").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("d")) - F.col("n")  # a row for each level
    placed = levels.select("cls", "d", F.floor(before / size).alias("at"), F.ceil(F.col("n") / size).alias("pieces"))
    piece = F.when(F.col("pieces") > 1, F.concat_ws(".", "at", "d", F.pmod(F.xxhash64("node"), F.col("pieces")))).otherwise(F.col("at").cast("string"))
    return far.join(placed, ["cls", "d"]).select("cls", "node", piece.alias("block"))


def _filled(pdf: pd.DataFrame, inflow: pd.DataFrame) -> pd.DataFrame:
    """z (I - P_bb) = inflow for one block."""
    own = pdf[pdf["p"].notna()]
    names = np.unique(pdf["i"].to_numpy(object))
    at = {x: k for k, x in enumerate(names)}
    m = np.eye(len(names))
    np.subtract.at(m, (own["j"].map(at).to_numpy(int), own["i"].map(at).to_numpy(int)), own["p"].to_numpy())
    right = np.zeros(len(names))
    np.add.at(right, inflow["to"].map(at).to_numpy(int), inflow["y"].to_numpy())
    return pd.DataFrame({"cls": pdf["cls"].iloc[0], "block": pdf["block"].iloc[0], "node": names, "z": np.linalg.solve(m, right)})


def irreducible_law(moves: DataFrame, size: int = SIZE, tolerance: float = 1e-11, most: int = 2000) -> DataFrame:
    """(cls, node, pi) of rows (cls, i, j, p), nodes being strings and each class connected both ways."""
    moves = cut(moves.select("cls", "i", "j", "p"))
    n = moves.select("cls", "i").distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    large = cut(n.filter(F.col("n") > size))
    law = "cls string, node string, pi double"
    if large.isEmpty():
        return moves.groupBy("cls").applyInPandas(_direct, law)
    small = moves.join(large, "cls", "left_anti").groupBy("cls").applyInPandas(_direct, law)
    moves = cut(moves.join(large.select("cls"), "cls", "left_semi"))
    block = cut(_block_of(moves, size))
    at = lambda end: block.select("cls", F.col("node").alias(end), F.col("block").alias(f"block_{end}"))
    told = cut(moves.join(at("i"), ["cls", "i"]).join(at("j"), ["cls", "j"]))
    inner = told.filter("block_i = block_j").select("cls", F.col("block_i").alias("block"), "i", "j", "p")
    # a row without a move keeps each node of a block in its table
    tables = cut(inner.unionByName(block.select("cls", "block", F.col("node").alias("i"), F.lit(None).cast("string").alias("j"), F.lit(None).cast("double").alias("p"))))
    x = cut(block.join(large, "cls").select("cls", "node", "block", (1 / F.col("n")).alias("v")))
    n_blocks = block.groupBy("cls").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0]
    law_of = (lambda c: c.groupBy("cls").applyInPandas(_direct, law)) if n_blocks <= size else (lambda c: irreducible_law(c, size, tolerance, most))
    folder, last = f"{shared_folder(moves.sparkSession).rstrip('/')}/stationary-{uuid.uuid4().hex}", 2.0
    for k in range(1, most + 1):
        flow = cut(x.withColumnRenamed("node", "i").join(told, ["cls", "i"]).select("cls", "block_i", "block_j", "j", (F.col("v") * F.col("p")).alias("f")))
        mass = flow.groupBy("cls", "block_i").agg(F.sum("f").alias("mass"))
        between = flow.groupBy("cls", "block_i", "block_j").agg(F.sum("f").alias("f")).join(mass, ["cls", "block_i"])
        weight = law_of(between.select("cls", F.col("block_i").alias("i"), F.col("block_j").alias("j"), (F.col("f") / F.col("mass")).alias("p")))
        scale = cut(weight.withColumnRenamed("node", "block_i").join(mass, ["cls", "block_i"]).select("cls", "block_i", (F.col("pi") / F.col("mass")).alias("by")))
        inflow = flow.filter("block_i <> block_j").join(scale, ["cls", "block_i"]).groupBy(F.col("cls").alias("cls"), F.col("block_j").alias("block"), F.col("j").alias("to")).agg(F.sum(F.col("f") * F.col("by")).alias("y"))
        filled = tables.groupBy("cls", "block").cogroup(inflow.groupBy("cls", "block")).applyInPandas(_filled, "cls string, block string, node string, z double")
        scaled = x.join(scale.withColumnRenamed("block_i", "block"), ["cls", "block"]).select("cls", "node", (F.col("v") * F.col("by")).alias("v"))
        # a table and not a checkpoint: that would keep the estimate of its size, which grows by powers from round to round
        filled.join(scaled, ["cls", "node"]).write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        both = moves.sparkSession.read.schema("cls string, block string, node string, z double, v double").parquet(f"{folder}/{k % 2}")
        whole = both.groupBy("cls").agg(F.sum("z").alias("__z"), F.sum("v").alias("__v"))
        both = both.join(F.broadcast(whole), "cls").withColumns({"z": F.col("z") / F.col("__z"), "v": F.col("v") / F.col("__v")})
        off = both.groupBy("cls").agg(F.sum(F.abs(F.col("z") - F.col("v"))).alias("off")).agg(F.max("off")).first()[0]
        x = both.select("cls", "node", "block", (F.col("z") if off <= 0.9 * last else (F.col("z") + F.col("v")) / 2).alias("v"))
        last = off
        if off <= tolerance:
            LOG.info("%d rounds of aggregation and disaggregation, last change %.1e", k, off)
            return small.unionByName(x.select("cls", "node", F.col("v").alias("pi")))
    raise NotConverged(f"the law still changes by {off:.1e} after {most} rounds")


def limit(given: DataFrame, size: int = SIZE, tolerance: float = 1e-11) -> DataFrame:
    """(mode, node, pi) of a chain (mode, i, j, p); nodes without moves stay where they are."""
    moves = cut(chain.closed(cut(given.select("mode", "i", "j", F.col("p").cast("double").alias("p")).filter("p > 0"))))
    name = lambda c: F.concat_ws("\x1f", F.col("mode").cast("string"), F.col(c).cast("string"))
    named = cut(moves.select("mode", "p", name("i").alias("i"), name("j").alias("j")))
    nodes = cut(chain.nodes_of(moves).withColumn("name", name("node")))
    alone = nodes.select(F.col("name").alias("node"), F.col("name").alias("cls"))
    labels = graph.strong_components(named.select("i", "j")).withColumnRenamed("label", "cls")
    label = cut(alone.join(labels.select("node", F.col("cls").alias("own")), "node", "left").select("node", F.coalesce("own", "cls").alias("cls")))
    at = lambda end: label.select(F.col("node").alias(end), F.col("cls").alias(f"cls_{end}"))
    told = cut(named.join(at("i"), "i").join(at("j"), "j"))
    open_ = cut(told.filter("cls_i <> cls_j").select(F.col("cls_i").alias("cls")).distinct())

    start = nodes.join(nodes.groupBy("mode").agg(F.count(F.lit(1)).alias("n")), "mode").select(F.col("name").alias("node"), (1 / F.col("n")).alias("v")).join(label, "node")
    weight = start.join(open_, "cls", "left_anti").select("cls", "v")
    if not open_.isEmpty():
        out = told.join(open_.withColumnRenamed("cls", "cls_i"), "cls_i", "left_semi").join(open_.select(F.col("cls").alias("cls_j"), F.lit(True).alias("goes_on")), "cls_j", "left")
        rates = cut(out.groupBy(F.col("i").alias("src"), F.when(F.col("goes_on"), F.col("j")).otherwise(balance.EXIT).alias("dst")).agg(F.sum("p").alias("rate")))
        transient = label.join(open_, "cls", "left_semi")
        reduced = balance.Reduced(rates, transient.select(F.col("node").alias("state"), F.col("cls").alias("block")), size)
        visits = reduced.mass(start.join(open_, "cls", "left_semi").select(F.col("node").alias("state"), F.col("v").alias("rate")), tolerance=tolerance)
        # visits of the jump chain are the mass times the rate of leaving, which is the sum of p
        handed = out.filter("goes_on is null").join(visits.withColumnRenamed("state", "i"), "i").select(F.col("cls_j").alias("cls"), (F.col("mass") * F.col("p")).alias("v"))
        weight = weight.unionByName(handed)
    weight = weight.groupBy("cls").agg(F.sum("v").alias("weight"))
    law = irreducible_law(told.join(open_.withColumnRenamed("cls", "cls_i"), "cls_i", "left_anti").select(F.col("cls_i").alias("cls"), "i", "j", "p"), size, tolerance)
    pi = law.join(weight, "cls").select(F.col("node").alias("name"), (F.col("pi") * F.col("weight")).alias("pi"))
    return nodes.join(pi, "name", "left").select("mode", "node", F.coalesce("pi", F.lit(0.0)).alias("pi"))

"""Graph operators on edges (i, j[, cost]): reachability, components, shortest times, betweenness.

Frontier loops: each round joins the newest rows with the edges and keeps what is new, with a cut. Results of pairs are long
tables; an unreachable pair has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.fixpoint import NotConverged, cut, until_stable


def hops(edges: DataFrame, sources: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """(source, node, d): breadth first from all nodes or the given (source)."""
    edges = cut(edges.select("i", "j").filter("i <> j").distinct())
    nodes = sources if sources is not None else edges.select(F.col("i").alias("source")).union(edges.select("j")).distinct()
    seen = front = cut(nodes.select("source", F.col("source").alias("node"), F.lit(0).alias("d")))
    for d in range(1, most + 1):
        new = front.join(edges, front["node"] == edges["i"]).select("source", F.col("j").alias("node")).distinct()
        front = cut(new.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front)) if d % 8 == 0 else seen.unionByName(front)
    raise NotConverged(f"nodes further than {most} hops")


def reached(edges: DataFrame, start: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, node) that can be reached from start (carry, node), itself included. Frontiers only; as many rounds as hops."""
    keys = [*carry, "node"]
    edges = edges.select(*carry, F.col("i").alias("node"), "j")
    seen = front = cut(start.select(*keys).distinct())
    d = 0
    while not front.isEmpty():
        d += 1
        new = front.join(edges, keys).select(*carry, F.col("j").alias("node")).distinct()
        front = cut(new.join(seen, keys, "left_anti"))
        seen = cut(seen.unionByName(front)) if d % 8 == 0 else seen.unionByName(front)
    return seen


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"))


def efficiency(distances: DataFrame, n: int) -> DataFrame:
    """Sum of 1 / d over n (n - 1); 1 for a single node."""
    if n <= 1:
        return distances.sparkSession.range(1).select(F.lit(1.0).alias("efficiency"))
    return distances.filter("d > 0").agg((F.coalesce(F.sum(1 / F.col("d")), F.lit(0.0)) / (n * (n - 1))).alias("efficiency"))


#: Rows of one key beyond which spread_join() doesn't send them to one task.
HOT = 200_000


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "left", most: int = HOT) -> DataFrame:
    """rows joined by key with a table that has one row for each key, however many rows a key has: rows of hot keys stay where they are and get theirs from a broadcast, of at most rows / most of them."""
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(key))
    if hot.isEmpty():
        return rows.join(one, key, how)
    told = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    spread = told.filter("__hot").drop("__hot").join(F.broadcast(one.join(F.broadcast(hot), key, "left_semi")), key, how)
    return spread.unionByName(told.filter("__hot is null").drop("__hot").join(one, key, how))


def components(edges: DataFrame, most: int = 10_000, hot: int = HOT) -> DataFrame:
    """(node, label): smallest node of each weakly connected component, by stars in turn.

    Edges lead from a larger node v to a smaller one p. Large stars: v goes to the smallest node next to p instead. Small
    stars: v and all its p go to the smallest p. Neither changes what is connected, and when neither changes anything, each
    component is a star around its smallest node. There are never more edges than at the start, and rows of one centre aren't
    joined in one task.
    """
    ends = cut(edges.select(F.greatest("i", "j").alias("v"), F.least("i", "j").alias("p")).distinct())
    nodes = ends.select(F.col("v").alias("node")).union(ends.select("p")).distinct()
    least = lambda x, name: x.groupBy(F.col("v").alias(name)).agg(F.min("p").alias("m"))
    state = cut(ends.filter("v > p"))
    for _ in range(most):
        large = cut(spread_join(state, least(state, "p"), "p", "left", hot).select("v", F.coalesce("m", "p").alias("p")).distinct())
        told = spread_join(large, least(large, "v"), "v", "inner", hot)
        new = cut(told.select("v", "m").union(told.filter("p > m").select("p", "m")).toDF("v", "p").distinct())
        if new.count() == state.count() and state.join(new, ["v", "p"], "left_anti").isEmpty():
            return nodes.join(state.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("p", "node").alias("label"))
        state = new
    raise NotConverged(f"components still changing after {most} rounds")


def giant(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component (of equals the one with the smallest label)."""
    own = components(edges)
    first = own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return own.join(first.select("label"), "label", "left_semi").select("node")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each strongly connected component.

    Colouring: every node takes the largest name that reaches it; a node that keeps its own is a root, and its component is
    what reaches it within its colour. Components found are taken out and the rest goes on. Tables are of the size of nodes
    and edges, never of pairs.
    """
    edges = cut(edges.select("i", "j").filter("i <> j").distinct())
    left = cut(edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct())
    found = None
    while not left.isEmpty():
        moves = cut(edges.unionByName(left.select(F.col("node").alias("i"), F.col("node").alias("j"))))

        def spread(state: DataFrame, moves: DataFrame = moves) -> DataFrame:
            return state.withColumnRenamed("node", "i").join(moves, "i").groupBy(F.col("j").alias("node")).agg(F.max("colour").alias("colour"))

        colours = until_stable(left.withColumn("colour", F.col("node")), spread, lambda a, b: a.join(b, ["node", "colour"], "left_anti"))
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"colour_{end}"))
        inside = edges.join(of("i"), "i").join(of("j"), "j").filter("colour_i = colour_j").select(F.col("colour_i").alias("colour"), F.col("j").alias("i"), F.col("i").alias("j"))
        own = cut(reached(inside, colours.filter("node = colour"), ("colour",)))
        labelled = own.join(own.groupBy("colour").agg(F.min("node").alias("label")), "colour").select("node", "label")
        found = labelled if found is None else found.unionByName(labelled)
        left = cut(left.join(own.select("node"), "node", "left_anti"))
        edges = cut(edges.join(left.withColumnRenamed("node", "i"), "i", "left_semi").join(left.withColumnRenamed("node", "j"), "j", "left_semi"))
    return found if found is not None else edges.select(F.col("i").alias("node"), F.col("j").alias("label"))


def irreducible(edges: DataFrame) -> bool:
    """Whether one node reaches all others and is reached by them."""
    edges = cut(edges.select("i", "j").distinct())
    nodes = edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()
    n = nodes.count()
    if n <= 1:
        return True
    start = cut(nodes.agg(F.min("node").alias("node")))
    return reached(edges, start).count() == n and reached(backward(edges), start).count() == n


#: Edges of all graphs together that shortest() sends to all tasks; beyond that it relaxes tables by joins.
MOST_EDGES = 2_000_000


def shortest(edges: DataFrame, sources: DataFrame | None = None, carry: tuple[str, ...] = (), most: int = 10_000, most_edges: int = MOST_EDGES) -> DataFrame:
    """(carry, source, node, t, via): least cost from each source, and the node before on the way: of equals the smallest (where costs of 0 or less are among them, the one found first, since ways could go in circles).

    `carry` columns keep several graphs apart in one run (a scenario for each closed hub, say). Graphs that fit a task go to
    all of them and sources are dealt out; larger ones are label correcting joins, where only rows that got better are
    relaxed again. Both relax until nothing changes, and add costs in the order of the way.
    """
    keys = [*carry, "source", "node"]
    edges = cut(edges.filter("i <> j").groupBy(*carry, "i", "j").agg(F.min("cost").alias("cost")))
    if sources is None:
        sources = edges.select(*carry, F.col("i").alias("source")).union(edges.select(*carry, "j")).distinct()
    plain = isinstance(edges.schema["i"].dataType, (T.IntegralType, T.StringType))
    size = edges.agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("least"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in carry)).first()
    if plain and 0 < size["n"] <= most_edges and size["least"] > 0 and not any(size[f"null_{c}"] for c in carry):
        return _shortest_in_tasks(edges, sources, carry, most)
    node = edges.schema["i"].dataType
    best = front = cut(sources.select(*carry, "source", F.col("source").alias("node"), F.lit(0.0).alias("t"), F.lit(None).cast(node).alias("via")))
    for _ in range(most):
        found = front.withColumnRenamed("node", "i").join(edges, [*carry, "i"]).select(*carry, "source", F.col("j").alias("node"), (F.col("t") + F.col("cost")).alias("t"), F.col("i").alias("via"))
        found = found.groupBy(*keys).agg(F.min(F.struct("t", "via")).alias("x")).select(*keys, "x.t", "x.via")
        old = best.select(*keys, F.col("t").alias("__old"))
        front = cut(found.join(old, keys, "left").filter(F.col("__old").isNull() | (F.col("t") < F.col("__old"))).drop("__old"))
        if front.isEmpty():
            return _smallest_via(best, edges, carry) if size["n"] and size["least"] > 0 else best
        best = cut(best.join(front.select(*keys), keys, "left_anti").unionByName(front))
    raise NotConverged(f"times still getting better after {most} rounds")


def _smallest_via(best: DataFrame, edges: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Final times with the smallest of the nodes before that give them, as tasks find it."""
    keys = [*carry, "source", "node"]
    before = best.select(*carry, "source", F.col("node").alias("i"), F.col("t").alias("__before"))
    ways = before.join(edges, [*carry, "i"]).select(*carry, "source", F.col("j").alias("node"), (F.col("__before") + F.col("cost")).alias("__t"), "i")
    own = ways.join(best.select(*keys, "t"), keys).filter(F.col("__t") == F.col("t")).groupBy(*keys).agg(F.min("i").alias("__via"))
    return best.join(own, keys, "left").select(*keys, "t", F.when(F.col("via").isNotNull(), F.col("__via")).alias("via"))


def _arranged(rows: pd.DataFrame) -> tuple:
    """(names, tails, costs, heads, first edge of each head, head of each edge) of a graph, edges by head."""
    names = np.array(sorted(set(rows["i"]) | set(rows["j"])), dtype=object)
    at = {x: k for k, x in enumerate(names)}
    a, b = (rows[c].map(at).to_numpy(np.int64) for c in "ij")
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    heads, starts = np.unique(b, return_index=True)
    return names, a, rows["cost"].to_numpy(float)[order], heads, starts, b


def _shortest_in_tasks(edges: DataFrame, sources: DataFrame, carry: tuple[str, ...], most: int, at_once: int = 4_000_000) -> DataFrame:
    """Blocks of sources, relaxed over all edges of their graph at a time until nothing changes."""
    spark, node = edges.sparkSession, edges.schema["i"]
    table = edges.toArrow().to_pandas()
    graphs = {key if isinstance(key, tuple) else (key,): _arranged(own) for key, own in table.groupby(list(carry))} if carry else {(): _arranged(table)}
    shared = spark.sparkContext.broadcast(graphs)
    schema = T.StructType([*(edges.schema[c] for c in carry), T.StructField("source", node.dataType), T.StructField("node", node.dataType), T.StructField("t", T.DoubleType()), T.StructField("via", node.dataType)])

    def solved(own: tuple | None, wanted: list) -> Iterator[tuple[list, list, np.ndarray, list]]:
        names, tails, costs, heads, starts, ends = own or (np.array([], dtype=object), *[np.array([], dtype=np.int64)] * 5)
        known = {x: k for k, x in enumerate(names)}
        if lost := [x for x in wanted if x not in known]:
            yield lost, lost, np.zeros(len(lost)), [None] * len(lost)
        wanted = [x for x in wanted if x in known]
        size = max(1, at_once // max(1, len(tails)))
        for at in range(0, len(wanted), size):
            block = np.array([known[x] for x in wanted[at : at + size]])
            t = np.full((len(block), len(names)), np.inf)
            t[np.arange(len(block)), block] = 0
            for _ in range(most):
                found = t[:, tails] + costs
                better = np.minimum(t[:, heads], np.minimum.reduceat(found, starts, axis=1))
                if (better == t[:, heads]).all():
                    break
                t[:, heads] = better
            else:
                raise NotConverged(f"times still getting better after {most} rounds")
            via = np.full(t.shape, len(names))
            via[:, heads] = np.minimum.reduceat(np.where(found == t[:, ends], tails, len(names)), starts, axis=1)
            via[np.arange(len(block)), block] = len(names)
            row, column = np.nonzero(np.isfinite(t))
            named = np.append(names, None)
            yield names[block[row]].tolist(), names[column].tolist(), t[row, column], named[via[row, column]].tolist()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: dict[tuple, list] = {}
            for *key, x in zip(*(batch.column(c).to_pylist() for c in [*carry, "source"]), strict=True):
                asked.setdefault(tuple(key), []).append(x)
            for key, wanted in asked.items():
                for source, target, t, via in solved(shared.value.get(key), wanted):
                    kind = batch.schema.field("source").type
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(t), batch.schema.field(c).type) for c, x in zip(carry, key, strict=True)), pa.array(source, kind), pa.array(target, kind), pa.array(t), pa.array(via, kind)], names=schema.names)

    asked = sources.select(*carry, F.col("source").cast(node.dataType).alias("source")).distinct()
    return asked.repartition(spark.sparkContext.defaultParallelism, *carry, "source").mapInArrow(kernel, schema)


def failures(edges: DataFrame, times: DataFrame, most: int = 10_000) -> DataFrame:
    """(removed, source, node, before, t): the pairs whose way in shortest() goes through a node, with their times before and without it (null: there is no way). All other pairs of other nodes keep theirs.

    times: shortest() of the edges (i, j, cost), with costs above 0. Pairs are found by going up the trees of ways, so there
    are as many rows as the ways have nodes inside. They start from the border, ends of edges whose way is still there, and
    are relaxed among themselves until nothing gets better.
    """
    edges = cut(edges.filter("i <> j").groupBy("i", "j").agg(F.min("cost").alias("cost")))
    tree = times.filter("via is not null").select("source", "node", "via")
    lost = front = cut(tree.filter("via <> source").withColumnRenamed("via", "removed"))
    up = tree.select("source", F.col("node").alias("removed"), F.col("via").alias("next")).filter("next <> source")
    d = 0
    while not front.isEmpty():
        d += 1
        front = cut(front.join(up, ["source", "removed"]).select("source", "node", F.col("next").alias("removed")))
        lost = cut(lost.unionByName(front)) if d % 8 == 0 else lost.unionByName(front)
    lost = cut(lost)

    keys = ["removed", "source", "node"]
    ends = lost.join(edges.withColumnRenamed("j", "node"), "node").filter("i <> removed")
    kept = ends.join(lost.select("removed", "source", F.col("node").alias("i")), ["removed", "source", "i"], "left_anti")
    known = times.select("source", F.col("node").alias("i"), F.col("t").alias("from"))
    best = front = cut(kept.join(known, ["source", "i"]).groupBy(*keys).agg(F.min(F.col("from") + F.col("cost")).alias("t")))
    for _ in range(most):
        if front.isEmpty():
            before = times.select("source", "node", F.col("t").alias("before"))
            return lost.join(before, ["source", "node"]).join(best, keys, "left").select(*keys, "before", "t")
        further = front.withColumnRenamed("node", "i").join(edges, "i").select("removed", "source", F.col("j").alias("node"), (F.col("t") + F.col("cost")).alias("t"))
        further = further.groupBy(*keys).agg(F.min("t").alias("t")).join(lost, keys, "left_semi")
        old = best.select(*keys, F.col("t").alias("__old"))
        front = cut(further.join(old, keys, "left").filter("__old is null or t < __old").drop("__old"))
        best = cut(best.join(front, keys, "left_anti").unionByName(front))
    raise NotConverged(f"times still getting better after {most} rounds")


def path(times: DataFrame, source, target) -> list:
    """Nodes of the way from shortest(), [] if there is none; `via` of one source only is read."""
    own = {r["node"]: r["via"] for r in times.filter(F.col("source") == F.lit(source)).select("node", "via").collect()}
    if target not in own:
        return []
    out = [target]
    while out[-1] != source:
        out.append(own[out[-1]])
    return out[::-1]


def betweenness(edges: DataFrame, sample: int | None = None, seed: int = 0, normalised: bool = True, most_nodes: int = 20_000, most_edges: int = 5_000_000) -> DataFrame:
    """(node, b) of a directed graph in hops: Brandes' accumulation for each source, level by level, sources dealt to tasks.

    The graph goes to all tasks; its nodes and edges are counted first. sample: so many sources, scaled up.
    """
    spark = edges.sparkSession
    rows = cut(edges.select("i", "j").filter("i <> j").distinct())
    nodes = rows.select(F.col("i").alias("node")).union(rows.select("j")).distinct()
    n, m = nodes.count(), rows.count()
    if n > most_nodes or m > most_edges:
        raise ValueError(f"{n} nodes and {m} edges are more than most_nodes and most_edges; sample the graph or raise the limits")
    names = [r[0] for r in nodes.orderBy("node").collect()]
    at = {x: k for k, x in enumerate(names)}
    ends = np.array([(at[a], at[b]) for a, b in rows.collect()], dtype=np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((n, ends[np.argsort(ends[:, 0], kind="stable")]))
    picked = np.random.default_rng(seed).permutation(n)[:sample] if sample and sample < n else np.arange(n)
    scale = (n / len(picked) if len(picked) else 1.0) / ((n - 1) * (n - 2) if normalised and n > 2 else 1.0)

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ends = shared.value
        first = np.searchsorted(ends[:, 0], np.arange(n + 1))
        total = np.zeros(n)
        for pdf in batches:
            for s in pdf["s"]:
                paths, depth = np.zeros(n), np.full(n, -1)
                paths[s], depth[s] = 1, 0
                front, levels = np.array([s]), []
                while len(front):
                    sizes = first[front + 1] - first[front]
                    here = np.repeat(first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    a, b = ends[here, 0], ends[here, 1]
                    depth[b[depth[b] < 0]] = depth[front[0]] + 1
                    down = depth[b] == depth[front[0]] + 1
                    a, b = a[down], b[down]
                    paths += np.bincount(b, paths[a], minlength=n)
                    levels.append((a, b))
                    front = np.unique(b)
                credit = np.zeros(n)
                for a, b in reversed(levels):
                    credit += np.bincount(a, paths[a] / paths[b] * (1 + credit[b]), minlength=n)
                credit[s] = 0
                total += credit
        yield pd.DataFrame({"k": np.arange(n), "b": total})

    wanted = spark.createDataFrame([(int(k),) for k in picked], "s int").repartition(min(max(1, len(picked)), spark.sparkContext.defaultParallelism))
    parts = wanted.mapInPandas(accumulate, "k int, b double").groupBy("k").agg((F.sum("b") * scale).alias("b"))
    labels = spark.createDataFrame(list(enumerate(names)), f"k int, node {edges.schema['i'].dataType.simpleString()}")
    return labels.join(parts, "k", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("b"))


def remove_node(chain: DataFrame, removed: DataFrame) -> DataFrame:
    """(removed, i, j, p): the chain without each of the nodes, rows scaled to 1 again; rows left empty stay where they are."""
    grid = chain.crossJoin(removed).filter("i <> removed")
    rest = grid.filter("j <> removed")
    scaled = rest.join(rest.groupBy("removed", "i").agg(F.sum("p").alias("__s")), ["removed", "i"]).select("removed", "i", "j", (F.col("p") / F.col("__s")).alias("p"))
    empty = grid.select("removed", "i").distinct().join(rest.select("removed", "i").distinct(), ["removed", "i"], "left_anti")
    return scaled.unionByName(empty.select("removed", "i", F.col("i").alias("j"), F.lit(1.0).alias("p")))


def breaking_nodes(edges: DataFrame) -> DataFrame:
    """(node, breaks): nodes without which the rest is no longer strongly connected.

    All removals in one run: from one node that stays, who is reached, and who reaches it, with the removed node as a key.
    """
    edges = cut(edges.select("i", "j").filter("i <> j").distinct())
    nodes = cut(edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct())
    n = nodes.count()
    ends = nodes.agg(F.min("node").alias("low"), F.max("node").alias("high"))
    start = cut(nodes.select(F.col("node").alias("removed")).crossJoin(ends).select("removed", F.when(F.col("removed") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("node")))

    def reach(moves: DataFrame) -> DataFrame:
        """As reached(), along the edges of the graph without the removed node."""
        moves = moves.select(F.col("i").alias("node"), "j")
        seen = front = start
        d = 0
        while not front.isEmpty():
            d += 1
            new = front.join(moves, "node").filter("j <> removed").select("removed", F.col("j").alias("node")).distinct()
            front = cut(new.join(seen, ["removed", "node"], "left_anti"))
            seen = cut(seen.unionByName(front)) if d % 8 == 0 else seen.unionByName(front)
        return seen.groupBy("removed").agg(F.count(F.lit(1)).alias("k"))

    both = reach(edges).unionByName(reach(backward(edges))).groupBy("removed").agg(F.min("k").alias("k"))
    return both.select(F.col("removed").alias("node"), (F.col("k") < max(n - 1, 1)).alias("breaks"))

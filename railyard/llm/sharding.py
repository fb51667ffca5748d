"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

Each shard has `points` virtual nodes on a ring of 64-bit hashes. A row belongs to the next point clockwise of its key's
hash. Shards have a capacity; rows that a full shard can't take go on clockwise to the next point whose shard has room.
All rows try their own point first, then those left over try the next one, and so on; at one point, points that come first
on the ring and rows with the smaller rank go first. The rank of a row is its place among the rows of its own point by
(key hash, key, text checksum).

Where rows end up only depends on how many rows each point has. So the walk runs on counts: one number for each point,
shards x points of them whatever the input. It yields ranges of ranks, at most one for each point and one for each time a
shard gets full; that is the bound of what is broadcast. Ranks come from windows over (point, slice), slices being ranges
of that order of about `slice_rows` rows, so that neither a point nor a single hot key makes a large window.

slack=0 gives capacities that add up to the number of rows: counts differ by one at most. slack>0 gives
ceil((1 + slack) * rows / shards): no shard is over that bound, and fewer rows move when a shard is added (README has
figures).

Cases: null keys are one key; null and empty texts have no bytes, very long texts count with all of theirs; rows that are
alike get different slots; an empty table gives no rows; other columns go along if named in `keep` (but those that the
result has itself).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railyard.llm.frames import checkpointed, fresh

#: Virtual nodes of a shard, and the rows that one ranking window holds about.
POINTS, SLICE_ROWS = 64, 50_000


def ring(n_shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(hash, shard) of the points in ring order. A shard's points don't depend on how many shards there are."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((at(s, v), s) for s in range(n_shards) for v in range(points))


def capacities(rows: int, n_shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * rows / n_shards)] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def walk(counts: dict[int, int], owners: Sequence[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Sends each point's rows clockwise. Returns (point, first rank, rank after the last, shard, first slot).

    Points whose shard is full are skipped (`ahead` leads to the next one with room), so the work is about one step for each
    point and for each range.
    """
    room, n = list(room), len(owners)
    taken, done, ranges = [0] * len(room), dict.fromkeys(counts, 0), []
    ahead, own_points, left_open = list(range(n)), defaultdict(list), sum(r > 0 for r in room)
    for p, shard in enumerate(owners):
        own_points[shard].append(p)

    def close(shard: int) -> None:
        for p in own_points[shard]:
            ahead[p] = (p + 1) % n

    def with_room(p: int) -> int:
        while ahead[p] != p:
            ahead[p] = ahead[ahead[p]]
            p = ahead[p]
        return p

    if left_open:
        for shard, r in enumerate(room):
            if r == 0:
                close(shard)
    heap = sorted((0, p) for p, c in counts.items() if c > 0)
    while heap and left_open:
        hop, p = heappop(heap)
        at = (p + hop) % n
        shard = owners[at]
        if room[shard]:
            k = min(room[shard], counts[p] - done[p])
            ranges.append((p, done[p], done[p] + k, shard, taken[shard]))
            room[shard] -= k
            taken[shard] += k
            done[p] += k
            if room[shard] == 0:
                left_open -= 1
                if left_open:
                    close(shard)
        if done[p] < counts[p] and left_open:
            heappush(heap, (hop + (with_room(at) - at) % n, p))
    return ranges


def _point(key_hash: Column, hashes: list[int]) -> Column:
    """Index of the first ring point after the hash: a binary search in a literal array."""
    size = 1 << (len(hashes)).bit_length()
    padded = F.lit(json.dumps(hashes + [2**63 - 1] * (size - len(hashes)))[1:-1].replace(" ", ""))
    array = F.split(padded, ",").cast("array<bigint>")
    steps = F.array(*(F.lit(size >> k) for k in range(1, size.bit_length())))
    below = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.element_at(array, found + step) <= key_hash, found + step).otherwise(found))
    return F.pmod(F.least(below, F.lit(len(hashes))), F.lit(len(hashes))).cast("int")


def assign(df: DataFrame, n_shards: int, key: str = "doc_id", text_col: str = "text", points: int = POINTS, slack: float = 0.0, slice_rows: int = SLICE_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each of df: key, `keep`, size (bytes of text + 8), text_crc32, shard and slot (from 0 without gaps in each shard)."""
    spark, nodes = df.sparkSession, ring(n_shards, points)
    keep = [c for c in keep if c.lower() not in (key.lower(), "size", "text_crc32", "shard", "slot")]
    h, point, row, rank, slice_, n, before, p, first, last, start = (fresh(x, [key], keep, ("size", "text_crc32", "shard", "slot")) for x in ("__hash", "__point", "__row", "__rank", "__slice", "__n", "__before", "__p", "__from", "__to", "__slot"))
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = df.select(F.col(key), *keep, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(key).alias(h))
    slim = checkpointed(slim.withColumn(point, _point(F.col(h), [x for x, _ in nodes])).withColumn(row, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in slim.groupBy(point).agg(F.count(F.lit(1)).alias(n)).collect()}  # n_shards * points rows at most
    ranges = walk(counts, [s for _, s in nodes], capacities(sum(counts.values()), n_shards, slack))
    rows = [dict(zip(("p", "first", "last", "shard", "start"), r, strict=True)) for r in ranges]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<p:int,first:bigint,last:bigint,shard:int,start:bigint>>"))).toDF(p, first, last, "shard", start)

    slices = max(1, math.ceil(max(counts.values(), default=1) / slice_rows))
    order = [h, key, "text_crc32", row]
    if slices == 1:
        ranked = slim.withColumn(rank, F.row_number().over(Window.partitionBy(point).orderBy(*order)) - 1)
    else:
        # ranges of the whole order, so that ranks are those of one slice; `row` only deals out rows that are alike
        slim = checkpointed(slim.repartitionByRange(math.ceil(sum(counts.values()) / slice_rows), point, *order).withColumn(slice_, F.spark_partition_id()))
        sizes = slim.groupBy(point, slice_).agg(F.count(F.lit(1)).alias(n))
        earlier = Window.partitionBy(point).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
        ahead = sizes.select(point, slice_, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
        within = F.row_number().over(Window.partitionBy(point, slice_).orderBy(*order)) - 1
        ranked = slim.join(ahead, [point, slice_]).withColumn(rank, within + F.col(before))
    placed = ranked.join(F.broadcast(plan), (F.col(point) == F.col(p)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(last)))
    return placed.select(key, *keep, "size", "text_crc32", "shard", (F.col(start) + F.col(rank) - F.col(first)).cast("long").alias("slot"))

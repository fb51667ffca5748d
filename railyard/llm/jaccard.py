"""N-gram Jaccard join with Bayesian pruning of candidates.

Which texts have a Jaccard similarity of at least `threshold` of their sets of word n-grams?

1. Texts become sorted sets of 64-bit shingle hashes (words in lower case, without marks at the ends) and a signature of
   MinHash values (16 bits each). Rows with the same set are one member from here on, counted (rows, and texts by their
   hashes) but not expanded; the aggregation runs before the shuffle as well.
2. MinHash values are cut into bands; members that agree in a band meet in a bucket. For links at the threshold the chance
   to meet in no band is about 2e-5 by default. Buckets with the same members count once. In each bucket MinHash values are
   compared a few at a time, and a pair is dropped when its posterior probability of reaching the threshold (uniform prior)
   is below `tolerance`. Only signatures travel, and only a spanning forest of the pairs that stay comes back. A large
   bucket is blocks with the bucket's smallest member in each; only members that this one doesn't reach in their block (few,
   in a group of near copies) meet the other blocks as well. The components of the forests (minimum labels, checkpointed)
   hold all links; texts that merely share boilerplate are in none.
3. Texts go to their component once for each block of it; each pair of blocks is one group, so a huge component is many tasks
   of bounded size. All pairs in a group are pruned as before, those that stay are verified exactly by the sizes of the
   intersections. Link counts come back, and a spanning forest of the links, not the links. Counting the links of m texts
   that are all linked takes m^2 / 2 comparisons, here as anywhere.
4. The components of the forests are the classes.

Cases: null text is the empty text; texts shorter than n words have one shingle, all their words; texts without any word
are alike and form one class; very long texts are read whole, as one member of 8 bytes a word; equal sets are one class;
repeated rows stay; ids may be of any type, null ones are the smallest; an empty table gives no rows; other columns are left out by join() and
kept by dedupe(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm.frames import arrow_map, checkpointed, fresh, sole_cache

N_WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 36, 6
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 24, 1e-6
#: Signatures of a block of a bucket; texts of a block of a component and their shingles, about; a kernel holds two blocks.
SIGNATURES, BLOCK, BLOCK_SHINGLES = 512, 512, 2_000_000
#: Texts on a side whose pairs are compared at a time.
TILE = 256
#: A set is hot if it has this share of all rows or more, and then its rows are dealt to so many parts; at most 1 / HOT sets are.
HOT, SALTS = 1 / 2000, 64
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”’…–—"
CACHED, CACHE_CHARS = 120_000, 48

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Token -> 64-bit hash of its word."""

    def __missing__(self, token: str) -> int:
        word = token.strip(EDGE).lower() or token
        found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[token] = found
        return found


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words."""
    tokens = (text or "").split()
    h = np.fromiter(map(_WORDS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = _mixed((out ^ h[i : i + len(out)]) * _M1)
    return np.unique(out)


@lru_cache(maxsize=4)
def _factors(k: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**32, size=k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhash(found: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values (32 bits) of a set."""
    factors = _factors(k)
    out = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    low = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[None, at : at + 2048] * factors[:, None]).min(axis=1), out=out)
    return out


def signature(found: np.ndarray, k: int) -> np.ndarray:
    """The lower 16 bits of k MinHash values: two sets that differ there agree in one by chance with 1 / 65536 only."""
    return (minhash(found, k) & np.uint32(0xFFFF)).astype("<u2")


def _beta_tail(a: int, b: int, x: float) -> float:
    """P(X >= x) of a beta distribution with whole parameters: a binomial tail."""
    n = a + b - 1
    logs = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * np.log(x) + (n - j) * np.log1p(-x) for j in range(a)]
    top = max(logs)
    return float(np.exp(top) * sum(np.exp(v - top) for v in logs))


@lru_cache(maxsize=8)
def least_matches(k: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which the posterior of similarity >= threshold is not below tolerance)."""
    return [(n, next(m for m in range(n + 1) if _beta_tail(m + 1, n - m + 1, threshold) >= tolerance)) for n in range(step, k + 1, step)]


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two signature tables that stay; same: both are one table, each pair counts once."""
    k = a.shape[1]
    plan = least_matches(k, min(step, k), threshold, tolerance)
    n, least = plan[0]
    matches = np.zeros((len(a), len(b)), dtype=np.int16)
    for j in range(n):
        matches += a[:, j, None] == b[None, :, j]
    keep = matches >= least
    if same:
        keep = np.triu(keep, 1)
    left, right = np.nonzero(keep)
    score, done = matches[left, right], n
    for n, least in plan[1:]:
        for at in range(0, len(left), 65536):
            part = slice(at, at + 65536)
            score[part] += (a[left[part], done:n] == b[right[part], done:n]).sum(axis=1, dtype=np.int16)
        ok = score >= least
        left, right, score, done = left[ok], right[ok], score[ok], n
    return left, right


def intersections(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[left] and b[right], exactly, by products of 0/1 tables of the shingles in both."""
    if len(left) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    union_a, union_b = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    both = np.intersect1d(union_a, union_b, assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        tables = []
        for sets in (a, b):
            own = np.zeros((len(sets), len(part)), dtype=np.float32)
            for i, s in enumerate(sets):
                lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], side="right")
                place = np.searchsorted(part, s[lo:hi])
                own[i, place[part[place] == s[lo:hi]]] = 1
            tables.append(own)
        out += tables[0] @ tables[1].T
    return np.rint(out[left, right]).astype(np.int64)


def links(a: list[np.ndarray], sig_a: np.ndarray, b: list[np.ndarray] | None, sig_b: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a similarity of at least threshold, in a (b is None) or between a and b."""
    other, sig = (a, sig_a) if b is None else (b, sig_b)
    left, right = survivors(sig_a, sig, threshold, tolerance, step, b is None)
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in other])
    shared = intersections(a, other, left, right)
    ok = shared >= threshold * (size_a[left] + size_b[right] - shared) - 1e-9
    return left[ok], right[ok]


def survivor_forest(table: np.ndarray, threshold: float, tolerance: float, step: int = STEP) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that connect what the surviving pairs of rows connect, fewer than rows, and the rows that row 0 isn't connected with: a search from each row through those not reached yet."""
    k = table.shape[1]
    plan = least_matches(k, min(step, k), threshold, tolerance)
    left, out, apart = np.arange(1, len(table)), [], None
    front = [0]
    while len(left):
        if not front:
            apart = left.tolist() if apart is None else apart
            front, left = [int(left[0])], left[1:]
            continue
        row, near, done, score = front.pop(), left, 0, 0
        for n, least in plan:
            score = score + (table[near, done:n] == table[row, done:n]).sum(axis=1)
            ok = score >= least
            near, score, done = near[ok], score[ok], n
        if len(near):
            out += [(row, int(x)) for x in near]
            front += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return out, apart or []


class Forest:
    """Edges that connect what the links seen so far connect, fewer than n."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        parent = self.parent

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            if len(self.edges) == len(parent) - 1:
                break
            if (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
                self.edges.append((i, j))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, of edges (src, dst). Nodes without edges are not in it.

    Minimum labels with pointer jumping: every node takes the smallest label near it, then the label of that label, until
    nothing changes. Rounds grow with the logarithm of a component's diameter; each ends in a checkpoint.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = checkpointed(both)
    state = checkpointed(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(state.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        # a node's own label may learn of it too: a hook from label to smaller label
        stepped = state.join(near, "node").withColumn("best", F.least("label", "near"))
        hooks = stepped.groupBy(F.col("label").alias("node")).agg(F.min("best").alias("hook"))
        # written down, so that both sides of the next join are shuffles of their own and a large component's label can be split
        joined = checkpointed(stepped.select("node", "label", "best").join(hooks, "node", "left").select("node", "label", F.least("best", "hook").alias("best")))
        jump = joined.select(F.col("node").alias("best"), F.col("best").alias("further"))
        moved = joined.select("node", "label", "best").join(jump, "best", "left").select("node", F.col("label").alias("old"), F.least("best", "further").alias("label"))
        moved = checkpointed(moved)
        if moved.filter("old <> label").isEmpty():
            return moved.select("node", "label")
        state = moved.select("node", "label")


def members(docs: DataFrame, id_col: str, text_col: str, n_words: int, k: int) -> DataFrame:
    """A slim row for each of docs: id, key (hash of the text), set (128-bit hash of its shingles), size, signature (k times 16 bits)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("key bigint, set binary, size bigint, signature binary").fields])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(_WORDS)
        for batch in batches:
            sets = [shingles(x, n_words) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([name_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s, k).tobytes() for s in sets], pa.binary()),
            ], names=schema.names)

    return arrow_map(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text")), kernel, schema)


def text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def name_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple | None, list[tuple] | None]]:
    """Rows of consecutive equal keys: (key, rows) for each group, and (None, None) after each batch."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:n_keys], []
            rows.append(row[n_keys:])
        yield None, None
    if rows:
        yield now, rows


def candidates(placed: DataFrame, k: int, threshold: float, tolerance: float) -> DataFrame:
    """For each group (bucket, i, j) a spanning forest (src, dst) of the pairs of its nodes that survive; and of groups that are parts, nodes that the smallest one isn't connected with, as src with their bucket and a null dst.

    placed: sorted by group; bucket, i, j, node, signature, part.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["src", "dst", "bucket"])
        sole_cache()
        for group, rows in _groups(batches, 3):
            if rows is not None and len(rows) > 1:
                rows = sorted(rows)  # so that the centre of a forest is the smallest node in every bucket
                table = np.frombuffer(b"".join(r[1] for r in rows), dtype="<u2").reshape(len(rows), k)
                edges, apart = survivor_forest(table, threshold, tolerance)
                found += [(rows[a][0], rows[b][0], None) for a, b in edges]
                found += [(rows[a][0], None, group[0]) for a in apart if rows[a][2]]
            if found and (rows is None or len(found) > 10_000):
                yield batch_of()
                found = []
        if found:
            yield batch_of()

    return arrow_map(placed, kernel, "src bigint, dst bigint, bucket bigint")


def compared(placed: DataFrame, n_words: int, k: int, threshold: float, tolerance: float) -> DataFrame:
    """Links of each group (label, i, j): rows (src, dst, n, n_texts, n_rows), links of set src to n sets with so many texts and rows if dst is null, else an edge of a forest.

    placed: sorted by group; label, i, j, block, set, n_texts, n_rows, text. Of blocks i < j the pairs across are compared, of i = j those within.
    """

    def linked(i: int, j: int, blocks: dict[int, dict[bytes, tuple]]) -> list[tuple]:
        own = [(name, *x) for name, x in blocks.get(i, {}).items()]
        other = own if i == j else [(name, *x) for name, x in blocks.get(j, {}).items()]
        every = own if i == j else own + other
        tables = [np.array([signature(x[1], k) for x in side], dtype=np.uint16).reshape(len(side), k) for side in ([own] if i == j else [own, other])]
        held = np.array([x[2:] for x in every], dtype=np.int64).reshape(len(every), 2)
        counts, sums, forest = np.zeros(len(every), dtype=np.int64), np.zeros((len(every), 2), dtype=np.int64), Forest(len(every))
        shift = 0 if i == j else len(own)
        for a in range(0, len(own), TILE):
            for b in range(a if i == j else 0, len(other), TILE):
                same = i == j and a == b
                left_sets, right_sets = [x[1] for x in own[a : a + TILE]], None if same else [x[1] for x in other[b : b + TILE]]
                left, right = links(left_sets, tables[0][a : a + TILE], right_sets, None if same else tables[-1][b : b + TILE], threshold, tolerance)
                left, right = left + a, right + b + shift
                ends, others = np.concatenate([left, right]), np.concatenate([right, left])
                counts += np.bincount(ends, minlength=len(every))
                np.add.at(sums, ends, held[others])
                forest.add(left, right)
        rows = [(every[v][0], None, int(counts[v]), int(sums[v, 0]), int(sums[v, 1])) for v in np.flatnonzero(counts)]
        return rows + [(every[a][0], every[b][0], 0, 0, 0) for a, b in forest.edges]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["src", "dst", "n", "n_texts", "n_rows"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, {}
        sole_cache(_WORDS)
        for batch in batches:
            rows = []
            for label, i, j, block, name, n_texts, n_rows, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, i, j) != now:
                    rows += linked(*now[1:], blocks) if now else []
                    now, blocks = (label, i, j), {}
                own = blocks.setdefault(block, {})
                if name not in own:
                    found = shingles(text, n_words)
                    if name_of(found) == name:  # else another text of the same id and key
                        own[name] = (found, n_texts, n_rows)
            yield batch_of(rows)
        if now:
            yield batch_of(linked(*now[1:], blocks))

    return arrow_map(placed, kernel, "src binary, dst binary, n bigint, n_texts bigint, n_rows bigint")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, tolerance: float = TOLERANCE, signatures: int = SIGNATURES, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each of docs: id_col, class_id (smallest id of the class), n_links (different sets that the row's set is linked to), n_same (rows with the row's own set), n_text_links and n_row_links (other texts and other rows that the row is linked to, those with its own set among them), text_key and class_key (hash of the row's text, and of the class's first text)."""
    k = bands * band_rows
    rows = checkpointed(members(docs, id_col, text_col, n_words, k))
    texts = rows.groupBy("set", "key").agg(F.min(F.struct("id")).alias("one"), F.count(F.lit(1)).alias("n"))
    named = texts.groupBy("set").agg(F.min(F.struct("one.id", "key")).alias("rep"), F.sum("n").alias("n_same"), F.count(F.lit(1)).alias("n_texts"))
    signed = rows.groupBy("set").agg(F.min("size").alias("size"), F.any_value("signature").alias("signature"))
    sets = checkpointed(named.join(signed, "set").withColumn("node", F.xxhash64("set")))  # 64 bits name a set while candidates are looked for: two sets of one name are only compared for nothing

    # who meets: buckets of two members or more, of those with the same members the one of the first band
    band = lambda t: F.struct(t.alias("band"), F.xxhash64(t, F.substring("signature", t * (2 * band_rows) + 1, F.lit(2 * band_rows))).alias("bucket"))
    spread = sets.select("node", F.inline(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("bucket")
    met = checkpointed(spread.join(shared, "bucket"))
    sizes = met.groupBy("bucket").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("print"))
    kept = sizes.groupBy("n", "first", "last", "print").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", "first", F.ceil(F.col("n") / signatures).cast("int").alias("blocks"))
    share = lambda of: F.pmod(F.xxhash64("node", F.lit(1)), F.col(of)).cast("int")
    each = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    grouped = checkpointed(met.select("node", "bucket").join(kept, "bucket").withColumn("block", share("blocks")))

    def forests(groups: DataFrame) -> DataFrame:
        signed = groups.join(sets.select("node", "signature"), "node").select("bucket", "i", "j", "node", "signature", "part")
        return checkpointed(candidates(signed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), k, threshold, tolerance))

    everywhere = F.when((F.col("node") == F.col("first")) & (F.col("blocks") > 1), each("blocks")).otherwise(F.array("block"))
    within = forests(grouped.select("bucket", "node", F.explode(everywhere).alias("i"), F.lit(0).alias("j"), (F.col("blocks") > 1).alias("part")))
    apart = within.filter("dst is null").select("bucket", F.col("src").alias("node")).distinct()
    parts = apart.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / signatures).cast("int").alias("parts"))
    split = grouped.select("bucket", "blocks").distinct().join(parts, "bucket")
    theirs = apart.join(split, "bucket").select("bucket", "node", share("parts").alias("i"), F.explode(each("blocks")).alias("j"))
    others = grouped.join(parts, "bucket").select("bucket", "node", F.explode(each("parts")).alias("i"), F.col("block").alias("j"))
    across = forests(theirs.unionByName(others).distinct().withColumn("part", F.lit(False)))
    near = components(within.unionByName(across).filter("dst is not null").select("src", "dst"))

    found = sets.select("set", "rep", "size", "n_texts", F.col("n_same").alias("n_rows"), "node").join(near, "node").drop("node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / block_shingles)).cast("int")
    dealt = found.join(found.groupBy("label").agg(blocks.alias("blocks")), "label").withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks")).cast("int"))
    body = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    dealt = body.join(dealt, F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("key") == F.col("rep.key")))
    paired = dealt.withColumn("other", F.explode(each("blocks")))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    placed = paired.select("label", *pair, "block", "set", "n_texts", "n_rows", "text").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    linked = checkpointed(compared(placed, n_words, k, threshold, tolerance))

    counts = linked.filter("dst is null").groupBy(F.col("src").alias("set")).agg(F.sum("n").alias("n_links"), F.sum("n_texts").alias("to_texts"), F.sum("n_rows").alias("to_rows"))
    classes = components(linked.filter("dst is not null").select("src", "dst")).withColumnRenamed("node", "set").join(sets.select("set", "rep"), "set")
    heads = classes.join(classes.groupBy("label").agg(F.min("rep").alias("head")), "label").join(counts, "set").select("set", "head", "n_links", "to_texts", "to_rows")
    every = sets.select("set", "rep", "n_same", "n_texts").join(heads, "set", "left")
    none = F.lit(0).cast("long")
    every = checkpointed(every.select("set", "n_same", F.coalesce("head", "rep").alias("head"), F.coalesce("n_links", none).alias("n_links"), *((F.coalesce(a, none) + F.col(b) - 1).alias(c) for a, b, c in (("to_texts", "n_texts", "n_text_links"), ("to_rows", "n_same", "n_row_links")))))

    # rows of hot sets are dealt to SALTS parts each; there are 1 / HOT hot sets at most, so their names can go to all tasks
    least = max(2, int(rows.count() * HOT))
    hot = checkpointed(every.filter(F.col("n_same") >= least).select("set", F.lit(True).alias("hot")))
    salted = rows.select("id", "key", "set").join(F.broadcast(hot), "set", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "key"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    heads = every.join(F.broadcast(hot), "set", "left").withColumn("salt", F.explode(salts)).drop("hot")
    return salted.join(heads, ["set", "salt"]).select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "n_links", "n_same", "n_text_links", "n_row_links", F.col("key").alias("text_key"), F.col("head.key").alias("class_key"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class with all its columns: the smallest id (of equal ids the smallest hash of the text, of equal texts any)."""
    found = join(docs, id_col, text_col, **options)
    head, key = (fresh(c, docs.columns) for c in ("head", "key"))
    heads = found.select(F.col("class_id").alias(head), F.col("class_key").alias(f"{key}_")).distinct()
    kept = docs.withColumn(key, text_key(text_col)).join(heads, F.col(id_col).eqNullSafe(F.col(head)) & (F.col(key) == F.col(f"{key}_")), "left_semi")
    return kept.dropDuplicates([id_col, key]).select(*docs.columns)

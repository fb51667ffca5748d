"""Document fingerprints by Order MinHash.

The k-mers of a text's code points are numbered by occurrence (the 2nd "abcdefgh" differs from the 1st). Each of `sketches`
hash functions selects the `picks` numbered k-mers with the smallest values; these k-mers, in the order in which they stand
in the text, are hashed as a tuple. Texts that edits turn into one another keep both k-mers and their order, so the share
of equal tuples falls with their edit distance; reordering a text changes it although its k-mers stay.

neighbour_edits() needs each document together with the one that follows it in descending id. Documents are dealt by ranges
of (id, two hashes of the text) straight to partitions and sorted there; only the first document of a range is sent to the
range before as well. So each text is shuffled once, no window or partition holds more than its range, and documents of one
id, or without any, are in as many ranges as they need. Only rows that are alike in id and text stay together; they are
fingerprinted once.

Cases: null text is the empty text; texts shorter than k have one k-mer, padded; very long texts are read whole, in memory of
a few times 8 bytes a character; equal texts have equal fingerprints; ids may be of any type that has an order; documents of
one id follow one another by descending hashes, those without id come last; a lone document follows itself; an empty table
gives no rows; fingerprint() keeps all columns, neighbour_edits() only those it names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm.frames import arrow_map, checkpointed

K, PICKS, SKETCHES = 8, 2, 64
#: Columns of the table of hash values that are made at a time, so that long texts take no more memory than short ones.
BLOCK = 4096
#: Bits for a k-mer's place beside 40 bits of its hash; longer texts are sorted in another way.
PLACE_BITS = 24

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    return x ^ (x >> np.uint64(29))


class OrderMinHash:
    def __init__(self, k: int = K, picks: int = PICKS, sketches: int = SKETCHES, seed: int = 7):
        self.k, self.picks = k, picks
        self.factors = np.random.default_rng(seed).integers(0, 2**32, size=sketches, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.rows = np.arange(sketches)

    def kmers(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        if len(points) < self.k:
            points = np.concatenate([points, np.zeros(self.k - len(points), np.uint64)])
        n = len(points) - self.k + 1
        h = np.zeros(n, np.uint64)
        for i in range(self.k):
            h = h * _M3 + points[i : i + n] * _M1
        return _mixed(h)

    def numbered(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k-mers sorted by hash, then place, and a 32-bit value of each with its occurrence number."""
        n, low = len(h), np.uint64(PLACE_BITS)
        if n < 1 << PLACE_BITS:
            keys = np.sort(h >> low << low | np.arange(n, dtype=np.uint64))
            same, place = keys >> low, (keys & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        else:
            place = np.argsort(h >> low, kind="stable")
            same = (h >> low)[place]
        index = np.arange(n)
        first = np.ones(n, bool)
        first[1:] = same[1:] != same[:-1]
        occurrence = index - np.maximum.accumulate(np.where(first, index, 0))
        return place, (_mixed(same * _M1 + occurrence.astype(np.uint64) * _M3) >> np.uint64(32)).astype(np.uint32)

    def tuples(self, text: str) -> np.ndarray:
        h = self.kmers(text)
        place, value = self.numbered(h)
        picks = min(self.picks, len(h))
        values, places = [], []
        for at in range(0, len(h), BLOCK):
            table = value[None, at : at + BLOCK] * self.factors[:, None]
            for _ in range(min(picks, table.shape[1])):
                best = table.argmin(axis=1)
                values.append(table[self.rows, best].astype(np.uint64))
                places.append(place[at + best])
                table[self.rows, best] = 0xFFFFFFFF
        chosen = np.array(places)
        if len(values) > picks:
            order = np.argsort(np.array(values), axis=0, kind="stable")[:picks]
            chosen = np.take_along_axis(chosen, order, axis=0)
        out = np.zeros(len(self.rows), np.uint64)
        for kmer in h[np.sort(chosen, axis=0)]:
            out = _mixed((out ^ kmer) * _M1)
        return (out >> np.uint64(48)).astype(">u2")

    def fingerprint(self, text: str | None) -> str:
        """Four hex digits for each sketch."""
        return self.tuples(text or "").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal tuples of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=">u2") for s in (a, b))
    return float((x == y).mean())


def fingerprint(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Adds `fingerprint`; replaces a column of that name."""
    df = df.drop("fingerprint")
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("fingerprint", T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrderMinHash(**options)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.fingerprint(x) for x in batch.column(at).to_pylist()], pa.string())], names=schema.names)

    return arrow_map(df, kernel, schema)


#: Keys of the sample from which the bounds of ranges are taken, for each range. It only decides how even they are.
SAMPLE = 100


def _ranges(keys: DataFrame, n: int) -> list[str]:
    """Lower bounds of the ranges but the first, as JSON of the key, from a sample by hash of about SAMPLE keys a range."""
    total = keys.count()
    every = max(1, total // (n * SAMPLE))
    sample = keys.filter(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(every)) == 0).orderBy(F.xxhash64("key", F.lit(3))).limit(4 * n * SAMPLE)
    found = [r[0] for r in sample.orderBy("key").select(F.to_json("key", {"ignoreNullFields": "false"})).collect()]
    return list(dict.fromkeys(found[len(found) * k // n] for k in range(1, n))) if found else []


def with_guests(df: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by descending key and sorted: to (partition), guest (1: only here to follow the last own row), id, body."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), F.xxhash64(body, F.lit(1)).alias("g"))
    keys = checkpointed(df.select(key.alias("key")))
    kind = keys.schema["key"].dataType
    bounds = _ranges(keys, n)
    size = 1 << len(bounds).bit_length()
    array = F.from_json(F.lit(f"[{','.join(bounds)}]"), T.ArrayType(kind))
    steps = F.array(*(F.lit(size >> k) for k in range(1, size.bit_length())))
    # how many bounds are not above the key, by binary search: the range
    at = lambda x: F.aggregate(steps, F.lit(0), lambda found, step: F.when((found + step <= len(bounds)) & (F.get(array, found + step - 1) <= x), found + step).otherwise(found))
    first = keys.withColumn("own", at(F.col("key"))).groupBy("own").agg(F.max("key").alias("key")).orderBy(F.desc("own"))
    ranges = [(r["own"], r["key"]) for r in first.select("own", F.to_json("key", {"ignoreNullFields": "false"}).alias("key")).collect()]  # n rows at most
    order = [own for own, _ in ranges]
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}
    leaders, places = dict(ranges), len(bounds) + 1
    leader = F.from_json(F.lit(f"[{','.join(leaders.get(p, 'null') for p in range(places))}]"), T.ArrayType(kind))
    hosts = F.from_json(F.lit(json.dumps([before.get(p, 0) for p in range(places)])), "array<int>")
    keyed = df.select(key.alias("key"), body.alias("body")).withColumn("own", at(F.col("key")))
    own, guest = (F.struct(to.alias("to"), F.lit(g).alias("guest")) for to, g in ((F.col("own"), 0), (F.get(hosts, F.col("own")), 1)))
    goes = F.when(F.col("key") == F.get(leader, F.col("own")), F.array(own, guest)).otherwise(F.array(own))
    dealt = keyed.withColumn("goes", F.explode(goes)).select("goes.*", "key", "body")
    return dealt.repartitionById(places, "to").sortWithinPartitions("to", "guest", F.desc("key"), "body").select("to", "guest", "key.id", "body")


def neighbour_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, **options) -> DataFrame:
    """One row for each of df: id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    edited is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's in descending id; the last one's next is the first.
    """
    fields = [df.schema[id_col], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next"))]
    schema = T.StructType(fields)
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrderMinHash(**options)
        at = last = None  # range; the last own row that still waits for its next: (id, text, tuples)
        text_of = lambda t: t.tobytes().hex()

        def pair(row, text, tuples):
            doc, old, mine = row
            half = len(old) // 2
            edited = old[: len(old) - half] + text[:half]
            other = mine if edited == old else own.tuples(edited)
            return doc, len(old), edited, text_of(mine), text_of(other), float((mine == other).mean()), float((mine == tuples).mean())

        for batch in batches:
            rows = []
            to, guest, ids, texts = (c.to_pylist() for c in batch.columns)
            for k, (t, g, doc, text) in enumerate(zip(to, guest, ids, texts, strict=True)):
                if t != at:
                    at, last = t, None
                if g and last is None:
                    continue  # another guest after the first, or a range without rows of its own
                tuples = last[2] if last is not None and last[1] == text else own.tuples(text)
                if last is not None:
                    rows.append(pair(last, text, tuples))
                last = None if g else (doc, text, tuples)
                texts[k] = None
            columns = [pa.array([r[0] for r in rows], batch.schema.types[2]), *(pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(types))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(with_guests(df, id_col, text_col, partitions), kernel, schema)

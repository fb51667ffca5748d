"""Line dedup: keys of lines that many documents hold are indexed by a sharded minimal perfect hash; documents probe its arrays.

The key of a line is the line without white space at its ends, in lower case (A-Z only). Lines whose key has `least_chars`
code points and is found in `least_docs` different documents or more stay in the largest id that holds it, and are taken out
of all others. A key goes by a digest of 128 bits, half of which is its place and half its fingerprint.

1. Documents give (place, fingerprint, id), once for each key. Counts and largest ids come from two aggregations: by key and
   id (no key is hot there), then by key (tasks send one partial row for a key, however often it occurs).
2. Keys found in `least_docs` documents are dealt by place into shards of about `shard_keys`. A task builds a shard's minimal
   perfect hash: bit arrays in levels, each with a set bit for every key that is alone at its bit, the others go on to the
   next; a key's number is the count of set bits before its own. Fingerprints, counts and owners are arrays in that order.
3. Shards go to the workers in passes of at most `pass_bytes`; in a pass each document looks its lines up in the arrays. A
   line that isn't in the index is let through by a fingerprint of 64 bits with a chance of 2**-64. No lines are joined and
   texts aren't shuffled. Between two passes there is a checkpoint of the documents: a bound of bytes should be chosen that
   gives a few passes.

Cases: null and empty texts are one empty line; very long texts are read whole; rows of one id are one document, all of them
keep what it owns; rows without id are one document together, which is smaller than all others; ids may be of any type that
can be ordered; repeated rows stay; other columns go along, but `n_lines` and `n_dropped` are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm.frames import arrow_map, checkpointed, fresh, sole_cache

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a shard, about, and bytes of arrays that a pass sends to the workers at most (one shard at least).
SHARD_KEYS, PASS_BYTES = 1 << 17, 64 << 20
#: Bits of a level for each key that it has to place, and the most levels.
GAMMA, LEVELS = 2, 96
#: Bytes of the arrays for each key, about: bits with their ranks, fingerprint, count, owner.
KEY_BYTES = 22

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def key_of(line: str) -> bytes:
    return line.strip(BLANK).encode().lower()  # of bytes, lower() only knows A-Z


def digests(texts: Sequence[str | None], least_chars: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and of the lines with long keys: text number, line number, place and fingerprint."""
    own, text_no, line_no, found = [], [], [], bytearray()
    for t, text in enumerate(texts):
        lines = lines_of(text)
        own.append(lines)
        for k, line in enumerate(lines):
            if len(line) >= least_chars and len(line.strip(BLANK)) >= least_chars:
                found += blake2b(key_of(line), digest_size=16).digest()
                text_no.append(t)
                line_no.append(k)
    pairs = np.frombuffer(bytes(found), "<u8").reshape(-1, 2)
    return own, np.array(text_no, np.int64), np.array(line_no, np.int64), pairs[:, 0], pairs[:, 1]


def _mixed(place: np.ndarray, fingerprint: np.ndarray, level: int) -> np.ndarray:
    x = place ^ (fingerprint + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build(place: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(words of bits, bits of each level, number of each key) of different keys."""
    words, sizes, at, bits = [], [], np.zeros(len(place), np.int64), 0
    left = np.arange(len(place))
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        to = (_mixed(place[left], fingerprint[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(to, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        mine = alone[to]
        at[left[mine]] = bits + to[mine]
        left, bits = left[~mine], bits + size
        sizes.append(size)
    if len(left):
        raise ValueError("keys that are alike")
    every = np.concatenate(words) if words else np.zeros(0, "<u8")
    return every, sizes, Arrays.rank(every, at)


class Arrays:
    """Shards put together for probing."""

    def __init__(self, n_shards: int, shards: Sequence[dict]):
        self.n_shards = n_shards
        deep = max((len(s["sizes"]) for s in shards), default=0)
        self.sizes = np.zeros((n_shards, deep + 1), np.uint64)  # 0: no such level, or another pass's shard
        self.starts = np.zeros((n_shards, deep + 1), np.int64)
        bits = 0
        for s in shards:
            for level, size in enumerate(s["sizes"]):
                self.sizes[s["shard"], level], self.starts[s["shard"], level] = size, bits
                bits += size
        whole = lambda name, kind: np.concatenate([np.frombuffer(s[name], kind) for s in shards]) if shards else np.zeros(0, kind)
        self.words = whole("words", "<u8")
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.fingerprints, self.counts, self.owners = whole("fingerprints", "<u8"), whole("counts", "<u4"), whole("owners", "<i8")

    @staticmethod
    def rank(words: np.ndarray, at: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Set bits before each place."""
        if before is None:
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        below = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(below)

    def find(self, place: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that aren't there."""
        out = np.full(len(place), -1, np.int64)
        shard = place.view(np.int64) % self.n_shards
        left = np.arange(len(place))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.starts[shard[left], level] + (_mixed(place[left], fingerprint[left], level) % size).astype(np.int64)
            hit = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            number = self.rank(self.words, at[hit], self.before)
            same = self.fingerprints[number] == fingerprint[left[hit]]
            out[left[hit][same]] = number[same]
            left = left[~hit]
        return out


def _own_id(df: DataFrame, id_col: str) -> F.Column:
    """Ids as whole numbers: themselves, or a hash of 64 bits."""
    return F.col(id_col).cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(place, fingerprint, n, owner): documents that hold a key, and the largest id of them as _own_id() has it."""
    slim = df.select(F.col(id_col).alias("id"), _own_id(df, id_col).alias("own"), F.col(text_col).alias("body"))
    schema = T.StructType([slim.schema["id"], T.StructField("own", T.LongType()), T.StructField("place", T.LongType()), T.StructField("fingerprint", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache()
        for batch in batches:
            _, text_no, _, place, fingerprint = digests(batch.column("body").to_pylist(), least_chars)
            _, first = np.unique(np.stack([text_no.astype(np.uint64), place, fingerprint]), axis=1, return_index=True)
            rows = pa.array(text_no[first])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("own").take(rows), pa.array(place[first].view(np.int64)), pa.array(fingerprint[first].view(np.int64))], names=schema.names)

    each = arrow_map(slim, kernel, schema).groupBy("place", "fingerprint", "id").agg(F.first("own").alias("own"))
    return each.groupBy("place", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max_by("own", "id").alias("owner"))


def index(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """(shards, their number, their keys) of counted() rows: shard, n, sizes of levels, bits, fingerprints, counts and owners."""
    keys = checkpointed(keys.filter("owner is not null"))  # what only rows without id hold stays
    n_keys = keys.count()
    n_shards = max(1, math.ceil(n_keys / shard_keys))
    shard = F.pmod("place", F.lit(n_shards)).cast("int")
    schema = "shard int, n long, sizes array<long>, words binary, fingerprints binary, counts binary, owners binary"

    def arrays(table: pa.Table) -> pa.Table:
        get = lambda c, kind: table.column(c).to_numpy().view(kind)
        place, fingerprint = get("place", np.uint64), get("fingerprint", np.uint64)
        words, sizes, number = build(place, fingerprint)
        order = np.argsort(number)
        counts = np.minimum(get("n", np.int64), 2**32 - 1).astype("<u4")
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(place)]), "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": [words.tobytes()],
            "fingerprints": [fingerprint[order].astype("<u8").tobytes()], "counts": [counts[order].tobytes()], "owners": [get("owner", np.int64)[order].astype("<i8").tobytes()],
        })

    return checkpointed(keys.withColumn("shard", shard).groupBy("shard").applyInArrow(arrays, schema)), n_shards, n_keys


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """df with the lines that stay as its text, n_lines (before) and n_dropped."""
    spark = df.sparkSession
    shards, n_shards, n_keys = index(counted(df, id_col, text_col, least_chars).filter(F.col("n") >= least_docs), shard_keys)
    at_once = max(1, pass_bytes // max(1, math.ceil(n_keys / n_shards) * KEY_BYTES))  # shards of a pass
    out = df.drop("n_lines", "n_dropped")
    kept = [f for f in out.schema.fields if f.name.lower() != text_col.lower()]
    own = fresh("own", out.columns)
    schema = T.StructType([*(f if f in kept else T.StructField(f.name, T.StringType()) for f in out.schema.fields), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = [f.name for f in schema.fields].index(next(f.name for f in out.schema.fields if f not in kept))
    given = T.StructType([*schema.fields, T.StructField(own, T.LongType())])
    out = out.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), own: _own_id(df, id_col)})

    for first in range(0, n_shards, at_once):
        part = shards.filter(F.col("shard").between(first, first + at_once - 1))
        sent = spark.sparkContext.broadcast((n_shards, part.orderBy("shard").toArrow().to_pylist()))  # pass_bytes at most

        def kernel(batches: Iterator[pa.RecordBatch], sent=sent, whole: bool = first == 0) -> Iterator[pa.RecordBatch]:
            sole_cache()
            arrays = Arrays(*sent.value)
            for batch in batches:
                texts, mine = batch.column(at).to_pylist(), batch.column(own)
                lines, text_no, line_no, place, fingerprint = digests(texts, least_chars)
                number = arrays.find(place, fingerprint)
                known = np.flatnonzero(number >= 0)
                ids, there = mine.fill_null(0).to_numpy(zero_copy_only=False), mine.is_valid().to_numpy(zero_copy_only=False)
                owner = there[text_no[known]] & (ids[text_no[known]] == arrays.owners[number[known]])
                gone = known[(arrays.counts[number[known]] >= least_docs) & ~owner]
                before = batch.column("n_dropped").to_numpy(zero_copy_only=False)
                dropped = before + np.bincount(text_no[gone], minlength=len(texts))
                taken: dict[int, set[int]] = {}
                for t, k in zip(text_no[gone].tolist(), line_no[gone].tolist(), strict=True):
                    taken.setdefault(t, set()).add(k)
                body = ["\n".join(x for k, x in enumerate(lines[t]) if k not in taken[t]) if t in taken else text or "" for t, text in enumerate(texts)]
                columns = list(batch.columns)
                columns[at] = pa.array(body, batch.schema.field(at).type)
                if whole:
                    columns[batch.schema.get_field_index("n_lines")] = pa.array([len(x) for x in lines], pa.int64())
                columns[batch.schema.get_field_index("n_dropped")] = pa.array(dropped, pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=given.names)

        out = arrow_map(checkpointed(out) if first else out, kernel, given)
    return out.drop(own)


def oracle() -> str:
    """DuckDB SQL of op11's rows."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS k FROM cut),
keyed AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{upper.lower()}') AS key FROM lines),
held AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
told AS (SELECT doc_id, line, k, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""

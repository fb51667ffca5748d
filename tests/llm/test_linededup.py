import hashlib
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railyard.llm import linededup, queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least_chars=20, least_docs=3):
    """The kept text, lines and lines dropped of each row."""
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: len(held.get(key(x), ())) >= least_docs and i != max(held[key(x)], key=lambda v: (v is not None, v or 0))  # noqa: B023, E731
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def documents():
    rnd = random.Random(5)
    lines = [f"line {k} says the same thing as ever" for k in range(60)] + ["short", "", " \t", "ÀÉ one line with other LETTERS é"]
    rows = []
    for i in range(200):
        own = [rnd.choice(lines[: 4 + i % 60]) for _ in range(rnd.randint(1, 12))] + rnd.choices(lines[-4:], k=2)
        rows.append((i, "\n".join(rnd.choice([x, x.upper(), f"  {x}\t\r"]) for x in own)))
    rows += [(None, lines[0]), (None, f"{lines[1]}\nby itself, without an id, thrice\nby itself, without an id, thrice"), (7, lines[2]), (7, lines[2]), (500, None), (501, ""), (502, "\n\n"), (503, f"{lines[3]}\n" * 5000 + "x" * 100_000)]
    return rows


def test_like_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(linededup.dedupe(df)) == brute(rows)
    # several shards, several passes, other bounds
    assert rows_of(linededup.dedupe(df, shard_keys=8, pass_bytes=400)) == brute(rows)
    assert rows_of(linededup.dedupe(df, least_chars=5, least_docs=1)) == brute(rows, 5, 1)


def test_columns_and_ids(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "a", 1, 2, "o") for i, t in rows], "doc_id long, Text string, place string, n_lines int, n_dropped int, own string")
    out = linededup.dedupe(df)
    assert out.columns == ["doc_id", "Text", "place", "own", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.Text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr) == brute(rows)
    assert {(r.place, r.own) for r in out.collect()} == {("a", "o")}
    named = [(None if i is None else f"{i:05d}", t) for i, t in rows]
    got = rows_of(linededup.dedupe(spark.createDataFrame(named, "doc_id string, text string")))
    assert got == sorted(((None if i is None else f"{i:05d}", *r) for i, *r in brute(rows)), key=repr)
    assert linededup.dedupe(df.limit(0)).count() == 0
    assert rows_of(linededup.dedupe(spark.createDataFrame([(1, "nothing is repeated here at all")], "doc_id long, text string"))) == [(1, "nothing is repeated here at all", 1, 0)]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 4))
def test_numbers_are_a_permutation(keys, n_shards):
    pairs = np.array(sorted(keys), np.uint64).reshape(-1, 2)
    shard = pairs[:, 0].view(np.int64) % n_shards if len(pairs) else np.zeros(0, np.int64)
    shards = []
    for s in range(n_shards):
        own = pairs[shard == s]
        words, sizes, number = linededup.build(own[:, 0].copy(), own[:, 1].copy())
        assert sorted(number.tolist()) == list(range(len(own)))
        order = np.argsort(number)
        shards.append({"shard": s, "sizes": sizes, "words": words.tobytes(), "fingerprints": own[order, 1].tobytes(), "counts": np.zeros(len(own), "<u4").tobytes(), "owners": np.zeros(len(own), "<i8").tobytes()})
    arrays = linededup.Arrays(n_shards, shards)
    assert sorted(arrays.find(pairs[:, 0].copy(), pairs[:, 1].copy()).tolist()) == list(range(len(pairs)))
    others = np.array([(a, b ^ 1) for a, b in keys if (a, b ^ 1) not in keys], np.uint64).reshape(-1, 2)
    assert (arrays.find(others[:, 0].copy(), others[:, 1].copy()) == -1).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        linededup.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def test_shards_are_bounded_and_counts_kept(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    keys = linededup.counted(df).filter("owner is not null")
    shards, n_shards, n_keys = linededup.index(keys, shard_keys=10)
    rows = shards.collect()
    assert sum(r.n for r in rows) == n_keys == keys.count() and n_shards == -(-n_keys // 10)
    assert sorted(np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).tolist()) == sorted(r.n for r in keys.collect())


def test_query_is_its_sql(spark):
    assert differences(spark, queries.op11_line_dedup, queries.ORACLES["op11_line_dedup"], SF) == ""
    got = {r.doc_id: r for r in queries.op11_line_dedup(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(str(Path(SF, "documents.parquet"))).select("doc_id", F.col("text")).collect()]
    for i, text, n, dropped in brute(docs):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())

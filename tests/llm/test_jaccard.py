import random

import numpy as np
import pytest

from railyard.llm import jaccard as ja


def corpus(n=220, seed=6):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeioustnrl", k=rnd.randint(2, 8))) for _ in range(900)]
    passage = rnd.choices(words, k=60)
    texts = []
    for i in range(n):
        body = rnd.choices(words, k=rnd.choice([1, 3, 4, 5, 6, 30, 80, 200]))
        if i % 5 == 0:
            body = passage + body
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 8])):
            copy = list(body)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                at = rnd.randrange(len(copy) + 1)
                copy[at : at + rnd.choice([0, 1])] = [rnd.choice(words)] * rnd.choice([0, 1])
            texts.append(rnd.choice([" ", "\n", "  "]).join(copy))
    base = rnd.choices(words, k=300)  # a chain and a large group
    for i in range(150):
        copy = list(base)
        copy[rnd.randrange(300)] = f"new{i}"
        copy[(7 * i) % 300] = "other"
        texts.append(" ".join(copy))
    body = rnd.choices(words, k=120)  # families that meet in buckets but aren't linked
    for family in range(3):
        tail = rnd.choices(words, k=40)
        for i in range(25):
            copy = body + tail
            copy[rnd.randrange(160)] = f"odd{family}x{i}"
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return texts + [None, "", " \n", texts[3], texts[3], "One, two three: FOUR five", "one two three four five", "word " * 20_000]


def brute(texts):
    """(class, links to different sets, rows of the same set) of each text, by all pairs."""
    sets = [frozenset(ja.shingles(t).tolist()) for t in texts]
    distinct = list(dict.fromkeys(sets))
    at = {s: i for i, s in enumerate(distinct)}
    parent, counts = list(range(len(distinct))), [0] * len(distinct)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            shared = len(a & b)
            if shared and 5 * shared >= 4 * (len(a) + len(b) - shared):
                counts[i] += 1
                counts[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    heads = {}
    for doc, s in enumerate(sets):
        heads.setdefault(root(at[s]), doc)
    return [(heads[root(at[s])], counts[at[s]], sets.count(s)) for s in sets]


@pytest.mark.parametrize("signatures, block, block_shingles, tile", [(ja.SIGNATURES, ja.BLOCK, ja.BLOCK_SHINGLES, 16), (11, 20, 3000, ja.TILE)])
def test_join_like_all_pairs(spark, monkeypatch, signatures, block, block_shingles, tile):
    monkeypatch.setattr(ja, "TILE", tile)
    texts = corpus()
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as n_links", "1 as label", "2 as set", "3 as key", "4 as id").repartition(5)
    parts = []
    monkeypatch.setattr(ja, "candidates", lambda placed, *options, own=ja.candidates: parts.append(placed.count()) or own(placed, *options))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_same) for r in ja.join(df, signatures=signatures, block=block, block_shingles=block_shingles).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert max(n for _, n, _ in want) > 50
    assert len(parts) == 2 and (parts[1] > 0) == (signatures == 11)


def test_dedupe(spark):
    texts = corpus(60)
    want = brute(texts)
    names = ["label", "head", "key", "key_", "__key", "set", "class_id"]
    df = spark.createDataFrame([(f"{i:05}", t, *names) for i, t in enumerate(texts)], "doc_id string, text string, " + ", ".join(f"{c} string" for c in names))
    kept = ja.dedupe(df).collect()
    assert sorted(int(r.doc_id) for r in kept) == sorted({c for c, _, _ in want})
    assert all(r.text == texts[int(r.doc_id)] and list(r)[2:] == names for r in kept)


def test_repeated_and_null_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(5, a), (5, a), (5, b), (None, a), (None, "x y"), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ja.join(df).count() == 6
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in ja.dedupe(df).collect()) == [(False, 5, b), (True, 0, a), (True, 0, "x y")]
    assert ja.join(df.limit(0)).count() == 0 and ja.dedupe(df.limit(0)).count() == 0


def test_survivor_forest_connects_what_survives():
    rnd = np.random.default_rng(3)
    for n in (2, 3, 40, 90):
        base = rnd.integers(0, 65536, size=(4, 216), dtype=np.uint16)
        table = base[rnd.integers(0, 4, n)]
        swap = rnd.random((n, 216)) < rnd.choice([0.0, 0.05, 0.12, 0.2], n)[:, None]
        table[swap] = rnd.integers(0, 65536, swap.sum(), dtype=np.uint16)
        left, right = ja.survivors(table, table, 0.8, 1e-6, 24, True)
        want, got = ja.Forest(n), ja.Forest(n)
        want.add(left, right)
        edges, apart = ja.survivor_forest(table, 0.8, 1e-6)
        got.add(*(np.array(x, dtype=int) for x in zip(*edges, strict=True))) if edges else None
        assert len(edges) == len(want.edges) == len(got.edges)
        reached = {0}
        while more := {b for a, b in want.edges + [(b, a) for a, b in want.edges] if a in reached} - reached:
            reached |= more
        assert sorted(apart) == sorted(set(range(n)) - reached)
        joined = ja.Forest(n)
        joined.add(np.array([a for a, _ in want.edges + edges], dtype=int), np.array([b for _, b in want.edges + edges], dtype=int))
        assert len(joined.edges) == len(want.edges)


def test_pruning_keeps_what_reaches_the_threshold():
    rnd = np.random.default_rng(1)
    kept = total = 0
    for _ in range(300):
        shared, own = rnd.integers(0, 2**63, 400, dtype=np.uint64), rnd.integers(0, 2**63, 96, dtype=np.uint64)
        a, b = np.sort(np.concatenate([shared, own[:48]])), np.sort(np.concatenate([shared, own[48:]]))
        sig = np.array([ja.minhash(a, 216), ja.minhash(b, 216)])
        kept += len(ja.survivors(sig, sig, 0.8, 1e-6, 24, True)[0])
        total += 1
    assert kept == total
    far = np.array([ja.minhash(rnd.integers(0, 2**63, 300, dtype=np.uint64), 216) for _ in range(40)])
    assert len(ja.survivors(far, far, 0.8, 1e-6, 24, True)[0]) == 0


def test_both_ways_to_intersect_agree():
    rnd = random.Random(2)
    sets = [np.array(sorted(rnd.sample(range(9000), rnd.randint(1, 60) if i else 6000)), dtype=np.uint64) for i in range(30)]
    left, right = map(np.array, zip(*[(i, j) for i in range(30) for j in range(i)], strict=True))
    assert len(left) > 4 * 60
    assert ja.intersections(sets, sets, left, right).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]


@pytest.mark.parametrize("block", [ja.BLOCK, 2])
def test_links_to_texts_that_differ_in_case_and_marks(spark, block):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"
    texts = [a, a.upper(), a.replace("three", "(three)"), a, a + ".", b, b.title(), b, "another text of five words", "Another text of five words!"]
    sets = [frozenset(ja.shingles(x).tolist()) for x in texts]
    linked = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    near = [[k for k in range(len(texts)) if k != i and linked(sets[i], sets[k])] for i in range(len(texts))]
    want = {i: (len({texts[k] for k in near[i]} - {texts[i]}), len(near[i])) for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_text_links, r.n_row_links) for r in ja.join(df, block=block).collect()} == want
    assert want[0] == (5, 7) and want[8] == (1, 1)

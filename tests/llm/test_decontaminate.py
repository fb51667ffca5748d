import random
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from railyard.llm import decontaminate as de


def distance(pattern, text):
    """Smallest edit distance to a substring, by dynamic programming."""
    points, steps = np.array([ord(c) for c in text], dtype=np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (points != ord(c)))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_myers(pattern, text):
    assert de.Myers(pattern).search(text)[0] == distance(pattern, text)


@cache
def cases():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(1, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(3, 40)))) for i in range(25)] + [(25, ""), (26, " \n"), (27, None), (28, "short"), (3, "another text of the item with id three, long enough")]
    items += [(30 + k, "".join(rnd.choices("abcdefgh ", k=k)).strip() + "q") for k in (4, 12, 19, 20, 25, 33, 40, 59, 60)]
    docs = []
    for i in range(160):
        item = items[rnd.choice([rnd.randrange(25), rnd.randrange(30, 39)])][1]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9, 20])):
            at = rnd.randrange(len(item) + 1)
            item = rnd.choice([item[:at] + "z" + item[at:], item[:at] + item[at + 1 :], item[:at] + "y" + item[at + 1 :]])
        docs.append((i, " ".join(word() for _ in range(rnd.randint(0, 60))) + "  " + item.upper() + "\n" + " ".join(word() for _ in range(rnd.randint(0, 60)))))
    docs += docs[:40] + docs[:9]
    return docs + [(None, docs[0][1]), (None, docs[0][1]), (200, None), (201, ""), (202, "a Short text"), (202, "a Short text"), (203, ("x" * 50 + " ") * 3000), (204, "another text of the item with id three, long enough " * 40)], items


@cache
def wanted():
    """(row of docs, id, item, (distance, budget)) by dynamic programming, with the five percent counted here."""
    (docs, items), want, known = cases(), {}, {}
    for n, (i, text) in enumerate(docs):
        text = de.normalise(text)
        for item, x in items:
            if item is not None and (x := de.normalise(x)):
                k = len(x) * 5 // 100
                if (x, text) not in known:
                    known[x, text] = distance(x, text) if len(text) < 5000 else (0 if x in text else k + 1)
                if (d := known[x, text]) <= k:
                    want[n, i, item] = min((d, k), want.get((n, i, item), (99, 0)))
    return want


@pytest.mark.parametrize("block_chars", [10**6, 300])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_find_and_clean_like_brute_force(spark, block_chars, kind):
    docs, items = cases()
    want = wanted()
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"id {i:04}")
    frame = spark.createDataFrame([(name(i), t, [7]) for i, t in docs], f"doc_id {kind}, text string, hits array<int>").selectExpr("*", "'x' as item_id", "2 as __hits")
    bench = spark.createDataFrame([(name(i), t) for i, t in items] * 2, f"item_id {kind}, text string")
    got = [(r.doc_id, r.item_id, r.distance, r.budget) for r in de.find(frame, bench, block_chars=block_chars).collect()]
    order = lambda x: (x[0] is not None, str(x))
    assert sorted(got, key=order) == sorted(((name(i), name(item), *d) for (_, i, item), d in want.items()), key=order)
    assert len(want) > 60 and {k for _, k in want.values()} >= {0, 1, 2, 3}
    kept = [(r.doc_id, r.text, r.hits, r.item_id, r["__hits"]) for r in de.clean(frame, bench, block_chars=block_chars).collect()]
    dirty = {n for n, *_ in want}
    key = lambda x: (str(x[0]), x[1] or "")
    assert sorted(kept, key=key) == sorted(((name(i), t, [7], "x", 2) for n, (i, t) in enumerate(docs) if n not in dirty), key=key)


def test_empty(spark):
    docs, items = cases()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert de.find(frame.limit(0), bench).count() == 0
    assert de.find(frame, bench.limit(0)).count() == 0
    assert de.clean(frame, bench.limit(0)).count() == len(docs)


def test_blank_items_are_in_no_block(spark):
    items = spark.createDataFrame([(k, x) for k, x in enumerate(["", " ", "   ", None, "ab", "cd "])], "item_id long, text string")
    for block_chars in (3, 100):
        assert sorted(x for b in de.blocks(items, "item_id", "text", block_chars) for x in b) == [(4, "ab"), (5, "cd ")]


def test_as_few_blocks_as_it_takes(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdef ", k=rnd.randint(5, 80))) + "x" for _ in range(1000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    total = sum(map(len, texts))
    for block_chars in (total, total - 1, total // 2, total // 5, 300):
        found = list(de.blocks(items, "item_id", "text", block_chars))
        assert len(found) <= -(-total // block_chars)
        assert all(sum(len(t) for _, t in b) < block_chars + 81 for b in found)
        assert sorted(x for b in found for x in b) == sorted(enumerate(texts))

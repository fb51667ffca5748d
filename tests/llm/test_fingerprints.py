import random

import numpy as np
import pytest

from railyard.llm import fingerprints as fp


def brute(text, own):
    """Order MinHash by its definition, with sorts."""
    text = text or ""
    h = own.kmers(text)
    seen, numbered = {}, []
    for i, x in enumerate(h.tolist()):
        x >>= fp.PLACE_BITS
        seen[x] = seen.get(x, -1) + 1
        numbered.append((x, seen[x], i))
    with np.errstate(over="ignore"):
        value = {i: int(fp._mixed(np.array([np.uint64(x) * fp._M1 + np.uint64(o) * fp._M3]))[0] >> np.uint64(32)) for x, o, i in numbered}
    out = []
    for f in own.factors.tolist():
        best = sorted(i for _, i in sorted((v * f % 2**32, i) for i, v in value.items())[: own.picks])
        t = np.zeros(1, np.uint64)
        for i in best:
            t = fp._mixed((t ^ h[i : i + 1]) * fp._M1)
        out.append(int(t[0] >> np.uint64(48)))
    return "".join(f"{x:04x}" for x in out)


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "ab" * 40, "the quick brown fox " * 9, "é𝒳" * 30, "".join(random.Random(1).choices("abcdef ", k=9000))])
def test_like_definition(text):
    own = fp.OrderMinHash(sketches=16)
    assert own.fingerprint(text) == brute(text, own)


def test_order_and_edits_matter():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(300)]
    text, own = " ".join(words), fp.OrderMinHash()
    one = " ".join(words[:100] + words[101:])
    swapped = " ".join(words[150:] + words[:150])
    other = " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(300))
    f = own.fingerprint
    assert fp.likeness(f(text), f(text)) == 1
    assert fp.likeness(f(text), f(one)) > 0.85 > 0.75 > fp.likeness(f(text), f(swapped)) > 0.2 > fp.likeness(f(text), f(other))


def test_long_sort_gives_the_same(monkeypatch):
    text = "".join(random.Random(9).choices("abc", k=3000))
    a = fp.OrderMinHash().fingerprint(text)
    monkeypatch.setattr(fp.OrderMinHash, "numbered", lambda self, h, f=fp.OrderMinHash.numbered: _wide(self, h))

    def _wide(self, h):
        place = np.argsort(h >> np.uint64(fp.PLACE_BITS), kind="stable")
        same = (h >> np.uint64(fp.PLACE_BITS))[place]
        first = np.r_[True, same[1:] != same[:-1]]
        occurrence = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        return place, (fp._mixed(same * fp._M1 + occurrence.astype(np.uint64) * fp._M3) >> np.uint64(32)).astype(np.uint32)

    assert fp.OrderMinHash().fingerprint(text) == a


@pytest.mark.parametrize("n, parts", [(1, 4), (2, 1), (3, 8), (200, 7), (200, 1)])
def test_neighbours(spark, n, parts):
    rnd = random.Random(n)
    texts = {i * 3 - 20: rnd.choice([None, "", "x", "same text of some length " * 3, "".join(rnd.choices("abcé ", k=rnd.randint(1, 300)))]) for i in range(n)}
    df = spark.createDataFrame([(i, t, "old") for i, t in texts.items()], "doc_id long, text string, edited string").repartition(3)
    got = {r.doc_id: r for r in fp.neighbour_edits(df, partitions=parts).collect()}
    order, own = sorted(texts, reverse=True), fp.OrderMinHash()
    assert set(got) == set(texts)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % n]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(t), edited, own.fingerprint(t), own.fingerprint(edited))
        assert (r.near_edited, r.near_next) == (fp.likeness(r.fingerprint, r.edited_fingerprint), fp.likeness(r.fingerprint, own.fingerprint(nxt)))


def test_hot_and_null_ids_are_many_ranges(spark):
    rows = [(5, f"text {k}") for k in range(300)] + [(None, f"null {k}") for k in range(200)] + [(k, f"own {k}") for k in range(100)] + [(3, "same")] * 40
    for kind, name in (("long", lambda i: i), ("string", lambda i: None if i is None else f"id {i:03}")):
        df = spark.createDataFrame([(name(i), t, 1, 2) for i, t in rows], f"doc_id {kind}, text string, key int, `to` int").repartition(4)
        sizes = fp.with_guests(df, "doc_id", "text", 16).filter("guest = 0").groupBy("to").count().collect()
        assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) < 100 and len(sizes) > 10
        got = sorted((r.doc_id is None, str(r.doc_id), r.n_chars, r.edited) for r in fp.neighbour_edits(df, partitions=16).collect())
        assert got == sorted((r.doc_id is None, str(r.doc_id), r.n_chars, r.edited) for r in fp.neighbour_edits(df, partitions=1).collect())
        assert len(got) == len(rows) and sum(n for *_, n, e in got) == sum(len(t) for _, t in rows)


def test_repeated_null_ids_and_empty(spark):
    rows = [(5, "a"), (5, "a"), (5, "b"), (None, "z"), (None, "z"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fp.neighbour_edits(df, partitions=3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
    assert fp.neighbour_edits(df.limit(0)).count() == 0
    assert fp.fingerprint(df).count() == 6

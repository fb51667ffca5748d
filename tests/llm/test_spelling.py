import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from railyard.llm import queries, spelling
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n, times=5):
    """{word: (n, n_near, form, form_n, root)}"""
    form, out = {}, {}
    for w in n:
        near = sorted((x for x in n if one_error(w, x)), key=lambda x: (-n[x], x))
        form[w] = near[0] if near and n[near[0]] >= times * n[w] else None
        out[w] = (n[w], len(near), form[w], n[form[w]] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


words = st.sets(st.text(alphabet="abé", max_size=7), max_size=60)


@settings(max_examples=200, deadline=None)
@given(words)
def test_automaton_numbers_words_in_order(given_words):
    order = sorted(given_words)
    automaton = spelling.Automaton(order)
    for k, w in enumerate(order):
        state, number = automaton.follow(automaton.start, 0, w)
        assert automaton.final[state] and number == k
    assert automaton.below[automaton.start] == len(order)
    # minimal: no two states accept the same
    assert len({(f, *((c, to) for c, (to, _) in m.items())) for f, m in zip(automaton.final, automaton.moves, strict=True)}) == len(automaton.final)


@settings(max_examples=200, deadline=None)
@given(words)
def test_each_pair_comes_out_once_in_one_window(given_words):
    automata = spelling.Pair(given_words)
    got = Counter()
    for w in given_words:
        half = len(w) // 2
        for a, b in ((0, half), (half, len(w) + 1)):
            got.update((w, x) for x in automata.near(w, a, b))
    want = {(a, b) for a in given_words for b in given_words if one_error(a, b) and (len(a), a) < (len(b), b)}
    assert got == Counter(want)


def test_variants_like_brute_force(spark):
    rnd = random.Random(3)
    n = {"".join(rnd.choices("abcé", k=rnd.randint(1, 9))): 5 ** rnd.randint(0, 6) + rnd.randint(0, 2) for _ in range(1500)}
    n |= {f"prefixes{a}{b}{c}": rnd.randint(1, 60) for a in "abcdefg" for b in "abcdefg" for c in "abc"} | {"": 3, "x" * 3000: 7, "x" * 2999: 90, "x" * 3001: 1}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    assert any(w[4] != w[2] for w in want.values() if w[2])
    assert found(spelling.variants(df)) == want
    # keys that are cut, down to windows of one letter, in many shards
    assert found(spelling.variants(df, most=12, shard_rows=100)) == want
    assert spelling.dealt(df, most=12).groupBy("key", "a", "b").count().filter("count > 12 and b - a > 1").isEmpty()
    assert spelling.variants(df.limit(0)).count() == 0


def test_words_of_documents(spark):
    rnd = random.Random(8)
    stock = ["Running", "runnin", "groß÷eÀß", "señorita", "senorita", "abcdef", "ABCDEFG"]
    rows = [(i, " ".join(rnd.choice(stock) for _ in range(rnd.randint(1, 40))) + rnd.choice([". short", "", "-x1abcdefgh2"])) for i in range(300)]
    rows += [(None, "Running running"), (None, None), (400, ""), (401, None), (5, rows[5][1]), (402, "longest" * 20_000 + " " + "running " * 9000)]
    n = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += len(run) >= 6
            run = ""
    n = {w: k for w, k in n.items() if k >= 5}
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert found(spelling.group(df)) == brute(n)
    assert found(spelling.group(df.limit(0))) == {}


def test_query_is_its_sql(spark):
    assert differences(spark, queries.op12_spelling_variants, queries.ORACLES["op12_spelling_variants"], SF) == ""

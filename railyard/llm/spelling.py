"""Spelling variants: words that differ by one letter, found in forward and backward minimal acyclic automata.

Words are counted, and those that are long and frequent enough are compared. Two words are near if one error (a letter
replaced, or one more or less) lies between them. Of a near pair with m letters in the shorter word, the error has a place q
from 0 to m, that of the first difference; the letters before q and those behind the error are the same. So a pair shares
its first half (q is in the window from m // 2 on), or its second half (q is in the window before).

1. A word of n letters goes to the windows of m = n, where it asks for words of its own length and of one letter more, and to
   those of m = n - 1, where it is found. A window's key is its ends and the letters before and behind it. Keys of more than
   `most` rows are cut: the window is halved, which fixes more letters, until it is one letter wide; then there are no more
   words than pairs of letters. Keys are dealt to shards of about `shard_rows` rows.
2. A shard has two minimal acyclic automata, one of the words and one of the words read backwards; each counts the words
   below a state, so that a walk yields the number of the word. An asking word is matched exactly up to the window in the
   automaton that has more letters to match, then completed with one error, then exactly. A letter that differs is taken
   only where it is the first difference, so a pair comes out once, in the window of its q.
3. Near pairs are counted by word. A word's form is its near word with the largest count, if that is `times` its own or
   more; roots follow the forms by joins until no word has a further form. Counts grow by `times` with each step, so there
   are at most log(rows) rounds.

Cases: null texts have no words; null ids are the empty string in the draw of errors; repeated rows count again; very long
texts and words are taken whole; of forms with equal counts the smallest by code points is taken; an empty table gives no
rows; other columns of the documents don't matter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.llm.frames import arrow_map, checkpointed, sole_cache

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_CHARS, LEAST_N, TIMES = 6, 5, 5
#: In one run of so many a letter is left out, by the checksum of its document and itself; 0: in none.
ERRORS = 199
#: Rows of a key beyond which its window is cut, and of a shard, about.
MOST, SHARD_ROWS = 10_000, 20_000
#: Different words that a task counts before it hands them on.
HELD = 200_000


def with_error(doc: str, run: str, errors: int = ERRORS) -> str:
    """The lower-case run, or without one letter if the draw of its document says so."""
    h = zlib.crc32(f"{doc}:{run}".encode()) if errors else 1
    at = h % len(run)
    return run[:at] + run[at + 1 :] if errors and h % errors == 0 else run


def words_of(doc: str, text: str | None, least_chars: int = LEAST_CHARS, errors: int = ERRORS) -> Counter[str]:
    found: Counter[str] = Counter()
    for run, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
        if len(run) >= least_chars and len(word := with_error(doc, run, errors)) >= least_chars:
            found[word] += n
    return found


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, errors: int = ERRORS) -> DataFrame:
    """(word, n) of all words with `least_chars` letters."""
    slim = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("body"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache()
        held: Counter[str] = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                held.update(words_of(doc, text, least_chars, errors))
            if len(held) >= HELD:
                yield batch_of()
                held.clear()
        if held:
            yield batch_of()

    return arrow_map(slim, kernel, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """Minimal acyclic automaton of sorted words, with their numbers."""

    def __init__(self, words: Sequence[str]):
        known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.moves: list[dict[str, tuple[int, int]]] = []  # letter -> (state, words that come before those behind it)
        self.below: list[int] = []

        def kept(final: bool, moves: dict[str, int]) -> int:
            """The one state that accepts what this one does."""
            key = (final, *moves.items())
            if (state := known.get(key)) is None:
                state = known[key] = len(self.final)
                n, numbered = int(final), {}
                for letter, to in moves.items():
                    numbered[letter] = (to, n)
                    n += self.below[to]
                self.final.append(final)
                self.moves.append(numbered)
                self.below.append(n)
            return state

        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # states of the last word that may still grow
        last = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                path[-1][1][last[len(path) - 1]] = kept(*state)

        for word in words:
            same = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            close(same)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        self.start = kept(*path[0])

    def follow(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        """(state, number of the first word behind it)."""
        moves = self.moves
        for letter in letters:
            move = moves[state].get(letter)
            if move is None:
                return None
            state, number = move[0], number + move[1]
        return state, number

    def near(self, word: str, a: int, b: int) -> Iterator[int]:
        """Numbers of the words that differ from this one first at q, a <= q < b, by another letter or by one more there."""
        at = self.follow(self.start, 0, word[:a])
        for q in range(a, min(b, len(word) + 1)):
            if at is None:
                return
            state, number = at
            own, rest, behind = word[q : q + 1], word[q:], word[q + 1 :]
            for letter, (to, n) in self.moves[state].items():
                if letter == own:
                    continue
                if own and (end := self.follow(to, number + n, behind)) and self.final[end[0]]:
                    yield end[1]
                if (end := self.follow(to, number + n, rest)) and self.final[end[0]]:
                    yield end[1]
            at = self.follow(state, number, own) if own else None


def first_difference(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Pair:
    """The forward and the backward automaton of some words."""

    def __init__(self, words: set[str]):
        self.words = sorted(words)
        self.backward_words = sorted(w[::-1] for w in words)
        self.forward, self.backward = Automaton(self.words), Automaton(self.backward_words)

    def near(self, word: str, a: int, b: int) -> Iterator[str]:
        """Words of as many letters or one more whose first difference is at q, a <= q < b; of two of one length the larger only."""
        m = len(word)
        if a >= m - b:
            found = (self.words[k] for k in self.forward.near(word, a, b))
        else:
            turned = (self.backward_words[k][::-1] for k in self.backward.near(word[::-1], m - b, m + 1))  # of equal letters in a row, the last differs backwards
            found = (w for w in turned if a <= first_difference(word, w) < b)
        return (w for w in found if len(w) > m or w > word)


def windows(words: DataFrame) -> DataFrame:
    """(word, n, m, a, b): each word in the two windows of m = its length and of m = one less."""
    each = words.select("*", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("m"))
    each, half = each.filter("m >= 0"), F.floor(F.col("m") / 2).cast("int")
    return each.select("*", F.inline(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("m") + 1).alias("b")))))


def _keyed(rows: DataFrame) -> DataFrame:
    behind = F.greatest(F.col("m") - F.col("b"), F.lit(0))
    return rows.withColumn("key", F.xxhash64("m", "a", "b", F.expr("left(word, a)"), F.when(behind > 0, F.expr("right(word, greatest(m - b, 0))")).otherwise("")))


def dealt(words: DataFrame, most: int = MOST) -> DataFrame:
    """windows() with keys of at most `most` rows (but windows of one letter)."""
    rows = _keyed(windows(words))
    done = None
    while True:
        rows = checkpointed(rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("b") - F.col("a")).alias("wide"))
        large = checkpointed(sizes.filter((F.col("size") > most) & (F.col("wide") > 1)).select("key"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
        cut = rows.join(large, "key", "left_semi").drop("key").filter("b - a > 1")
        rows = _keyed(cut.select("word", "n", "m", F.inline(halves)))


def pairs(words: DataFrame, most: int = MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, near, near_n) of (word, n): each near pair once."""
    rows = checkpointed(dealt(words, most))
    n_shards = max(1, -(-rows.count() // shard_rows))
    schema = "word string, n long, near string, near_n long"

    def found(table: pa.Table) -> pa.Table:
        word, n, m, a, b = (table.column(c).to_pylist() for c in ("word", "n", "m", "a", "b"))
        own = dict(zip(word, n, strict=True))
        automata = Pair(set(own))
        out = [(w, x) for w, m_, a_, b_ in zip(word, m, a, b, strict=True) if len(w) == m_ for x in automata.near(w, a_, b_)]
        return pa.table({"word": pa.array([w for w, _ in out], pa.string()), "n": pa.array([own[w] for w, _ in out], pa.int64()), "near": pa.array([x for _, x in out], pa.string()), "near_n": pa.array([own[x] for _, x in out], pa.int64())})

    return rows.withColumn("shard", F.pmod("key", F.lit(n_shards))).groupBy("shard").applyInArrow(found, schema)


def variants(words: DataFrame, times: int = TIMES, most: int = MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of different words with their counts (word, n)."""
    both = F.inline(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = pairs(words, most, shard_rows).select(both).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    told = words.join(best, "word", "left")
    has = -F.col("best.order") >= times * F.col("n")
    told = checkpointed(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.order")).alias("form_n")))

    further = told.filter("form is not null").select(F.col("word").alias("at"), F.col("form").alias("to"))
    going = further.select(F.col("at").alias("word"), F.col("to").alias("at"))
    roots = None
    while True:
        step = checkpointed(going.join(further, "at", "left"))
        ended = step.filter("to is null").select("word", F.col("at").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        going = step.filter("to is not null").select("word", F.col("to").alias("at"))
        if going.isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, times: int = TIMES, errors: int = ERRORS, most: int = MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """variants() of the words of documents that occur `least_n` times or more."""
    return variants(checkpointed(counts(df, id_col, text_col, least_chars, errors).filter(F.col("n") >= least_n)), times, most, shard_rows)


def oracle() -> str:
    """DuckDB SQL of op12's rows: near words share a word with one letter blanked out, or one is the other without a letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    byte = "CAST(('0x' || substr(hex(encode(s)), 2 * i + 1, 2)) AS BIGINT)"
    return f"""
WITH RECURSIVE bits(b, k, x) AS (SELECT r, 0, r FROM (SELECT unnest(range(256)) AS r) UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c, CAST(doc_id AS VARCHAR) || ':' || run AS s FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY doc_id, run),
summed AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(s))), lambda i: {byte})), lambda h, v: xor(h >> 8, t[CAST(xor(h & 255, v) AS BIGINT) + 1])), 4294967295) AS h FROM per, crc),
said AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM said WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_N}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS q FROM words),
gaps AS MATERIALIZED (SELECT word, n, q, substr(word, 1, q - 1) || '.' || substr(word, q + 1) AS blank, substr(word, 1, q - 1) || substr(word, q + 1) AS less FROM places),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.blank = b.blank AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM gaps a JOIN words w ON a.less = w.word
  UNION SELECT w.word, a.word, a.n FROM gaps a JOIN words w ON a.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
told AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
ways(word, root) AS (SELECT word, word FROM told UNION ALL SELECT ways.word, told.form FROM ways JOIN told ON ways.root = told.word WHERE told.form IS NOT NULL)
SELECT told.word, told.form, ways.root, told.n, told.n_near, told.form_n FROM told JOIN ways USING (word) JOIN told ends ON ends.word = ways.root WHERE ends.form IS NULL"""

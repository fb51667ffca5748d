"""Secret scans, with DataFrame functions only.

Two kinds of spans. Base spans come from fixed patterns (assignments to secret-like names, access key ids, long hex runs).
The method's own come from two character Markov models, one of random strings and one of ordinary identifiers, trained on
labelled samples: each long token gets the sum of log P(next | char) under the first minus that under the second, and is a
span of kind `markov` if the sum reaches `threshold`, also where a base span covers it or a part of it.

train() takes the ordinary words from a bounded sample of the documents themselves, so that the models know their languages.
Lower-case hex is no part of the random sample: runs of 24 and more are base spans, shorter ones stand in UUIDs, digests and
version names, which are ordinary. Tokens shorter than 12 characters are left to the patterns: a first-order model can't
tell a random string of that length from a rare word (README has recall by length).

Spans are in code points, end exclusive. They are found natively: a pattern's matches and the pieces between them
(regexp_extract_all and split) give the lengths whose running sums are the positions. Running sums are made in blocks, so
the work is in proportion to the text and its hits.

Cases: null text is the empty text; no spans give counts of 0, an empty string of spans and its digest; very long texts and
tokens are read as a whole; repeated rows are scanned each; an empty table gives no rows; all other columns are carried
along untouched, and redact() changes the text column only.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.llm.frames import fresh

#: The patterns of base spans, in the order that breaks ties of start, and what a match needs to count.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models look at, and the log-likelihood ratio (nats) from which one is a secret.
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
THRESHOLD = 15.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LOWER, UPPER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]

#: Bounds of the sample that train() fits on: documents, different words of them and the letters of one, strings made of each label.
SAMPLE_DOCS, SAMPLE_WORDS, WORD_CHARS, SAMPLE_STRINGS = 2000, 20_000, 64, 20_000

#: Words that every ordinary sample has, whatever the documents hold.
WORDS = (
    "user name file path config value index count list item node edge table column row field type class object string number "
    "buffer cache client server request response handler manager service factory builder parser reader writer stream socket "
    "thread process queue stack event listener message channel session context state status error warning default current "
    "previous next total length width height offset limit timeout retry version release project module package import export "
    "public private static final abstract interface the and that with from this which there would about other their into time"
).split()


def _ordinary(rnd: random.Random, words: Sequence[str]) -> str:
    """An ordinary identifier: words in a usual style, or one of the strings without words that files hold."""
    style, pick = rnd.randrange(15), rnd.choices(words, k=rnd.randint(1, 5))
    if style < 10:
        joined = ("_".join(pick), "-".join(pick), "/".join(pick), "=".join(pick), "".join(pick), "".join(w.title() for w in pick), "_".join(pick).upper(), "".join(pick).upper(), pick[0], pick[0])[style]
        return joined + (str(rnd.randint(0, 2100)) if rnd.random() < 0.2 else "")
    if style == 10:  # a rule of one character or two marks
        return rnd.choice([rnd.choice(ALPHABET), "".join(rnd.choices(ALPHABET[62:], k=2))]) * rnd.randint(8, 40)
    if style == 11:  # a UUID
        hexes = rnd.choice([DIGITS + "abcdef", DIGITS + "ABCDEF"])
        return "-".join("".join(rnd.choices(hexes, k=k)) for k in (8, 4, 4, 4, 12))
    if style == 12:  # part of an alphabet or a row of keys
        run = rnd.choice([LOWER, UPPER, DIGITS, LOWER + DIGITS, UPPER + LOWER + DIGITS, "qwertyuiopasdfghjklzxcvbnm"])
        at = rnd.randrange(len(run))
        return (run * 3)[at : at + rnd.randint(8, 36)]
    if style == 13:
        return "".join(rnd.choices(DIGITS, k=rnd.randint(8, 30)))
    return f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}{rnd.choice(['', 'T', '_'])}{rnd.randint(0, 235959):06}"


def labelled_samples(n: int = SAMPLE_STRINGS, seed: int = 11, words: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(string, 1 if random): n random keys over usual alphabets, n ordinary identifiers and the words; the same for each seed."""
    rnd = random.Random(seed)
    alphabets = [LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "-_", LOWER + DIGITS, UPPER + DIGITS]
    rows = [("".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(16, 64))), 1) for _ in range(n)]
    # the fixed words as often as those of the documents, at most ten times each
    known = [*words, *WORDS * max(1, min(10, len(words) // len(WORDS)))]
    return rows + [(_ordinary(rnd, known), 0) for _ in range(n)] + [(w, 0) for w in words]


class MarkovPair:
    """Log-likelihood ratio of each pair of characters, with add-`prior` smoothing."""

    def __init__(self, samples: Iterable[tuple[str, int]], prior: float = 0.5):
        pairs: tuple[Counter, Counter] = (Counter(), Counter())
        for s, label in samples:
            pairs[label].update(zip(s, s[1:]))  # noqa: B905
        size = len(ALPHABET)
        from_char = [Counter() for _ in pairs]
        for label in (0, 1):
            for (a, _), k in pairs[label].items():
                from_char[label][a] += k
        p = lambda label, a, b: (pairs[label][a, b] + prior) / (from_char[label][a] + prior * size)
        self.ratio = {(a, b): round(math.log(p(1, a, b) / p(0, a, b)), 3) for a in ALPHABET for b in ALPHABET}

    def score(self, token: str) -> float:
        return sum(self.ratio[x] for x in zip(token, token[1:]))  # noqa: B905

    def column(self, token: Column) -> Column:
        """score() as an expression; the table is one literal array."""
        n = len(ALPHABET)
        table = F.split(F.lit(",".join(str(self.ratio[a, b]) for a in ALPHABET for b in ALPHABET)), ",").cast("array<double>")
        codes = F.split(F.lit(",".join(str(max(0, ALPHABET.find(chr(i)))) for i in range(128))), ",").cast("array<int>")
        code = lambda c: F.element_at(codes, F.ascii(c) + 1)
        steps = lambda chars: F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.element_at(table, code(a) * n + code(b) + 1))
        return F.aggregate(let(F.split(token, ""), steps), F.lit(0.0), lambda total, x: total + x)


@lru_cache(maxsize=1)
def default_models() -> MarkovPair:
    """Models that know no documents, only the fixed words."""
    return MarkovPair(labelled_samples(4000))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, seed: int = 11) -> MarkovPair:
    """Models whose ordinary sample has words of the documents: of the sample_docs ids with the smallest hash, without base spans, the sample_words different words with the smallest hash."""
    ids = docs.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col)).join(F.broadcast(ids.withColumnRenamed("__id", "__one")), F.col("__id").eqNullSafe(F.col("__one")), "left_semi")
    words = picked.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("word")).filter(F.length("word") <= WORD_CHARS).distinct()
    found = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(sample_words).collect()]
    return MarkovPair(labelled_samples(seed=seed, words=found))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Elements that a running total goes through at a time.
RUN = 128


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of numbers from 0 on under an associative operation.

    A fold that appends copies what it has at each step. So totals are made in blocks of RUN elements, then the blocks are
    put together.
    """
    empty = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(block, start, lambda acc, x: let(add(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out"))))["out"]

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: within(F.slice(v, k * RUN + 1, F.lit(RUN))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        joined = F.aggregate(blocks, start, lambda acc, b: F.struct(add(acc["at"], F.element_at(b, -1)).alias("at"), F.concat(acc["out"], F.array(F.transform(b, lambda y: add(acc["at"], y)))).alias("out")))
        return F.when(F.size(v) > 0, F.flatten(joined["out"])).otherwise(empty)

    return let(values, whole)


SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern as structs (start, kind, end, s: the string); null if there are none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(hits, lambda h: F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(h)), h, lambda gap, hit: F.struct((F.char_length(gap) + F.char_length(hit)).alias("step"), F.char_length(hit).alias("n"), hit.alias("s"))))
    ends = lambda p: running(F.transform(p, lambda x: x["step"]), lambda a, b: a + b)
    spans = let(pairs, lambda p: F.zip_with(p, ends(p), lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["s"].alias("s"))))
    return F.when(text.rlike(pattern), spans)


def scan(df: DataFrame, text_col: str = "text", models: MarkovPair | None = None, threshold: float = THRESHOLD, base_col: str = "base", found_col: str = "found") -> DataFrame:
    """Adds base_col and found_col: arrays of (start, kind, end) sorted by start, then kind (an index of KINDS); the second holds the first too. They replace columns of these names."""
    models = models or default_models()
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    spans = lambda c: F.coalesce(F.transform(c, short), F.array().cast(f"array<{SPAN}>"))
    assigned = F.filter(_matches(text, ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["s"], ASSIGN, 2)) >= ASSIGN_CHARS)
    random_like = F.filter(_matches(text, TOKEN, 3), lambda x: models.column(x["s"]) >= threshold)
    kept = df.drop(base_col, found_col)
    kept = kept.select("*", F.array_sort(F.concat(spans(assigned), spans(_matches(text, ACCESS, 1)), spans(_matches(text, HEX, 2)))).alias(base_col), spans(random_like).alias(found_col))
    return kept.withColumn(found_col, F.when(F.size(found_col) > 0, F.array_sort(F.concat(base_col, found_col))).otherwise(F.col(base_col)))


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


#: Code points of the pieces that redact() cuts a text into, so that it needn't look for each place from the beginning.
CHUNK = 4096


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", **options) -> DataFrame:
    """The same rows with each secret (overlapping spans: the whole of them) replaced by `mark`; texts without any stay as they are."""
    base, found = fresh("base", df.columns), fresh("found", df.columns)
    spans, text = scan(df, text_col, base_col=base, found_col=found, **options), F.col(text_col)

    def built(chunks: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            """The code points from a to b of the text."""
            i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            many = F.concat(F.substring(F.element_at(chunks, i + 1), a - i * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(F.element_at(chunks, j + 1), F.lit(1), b - j * CHUNK))
            return F.when(b <= a, F.lit("")).when(i == j, F.substring(F.element_at(chunks, i + 1), a - i * CHUNK + 1, b - a)).otherwise(many)

        def whole(ends: Column) -> Column:
            # a span that begins before the end of those before it only makes their mark stand for more
            before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            parts = F.zip_with(F.col(found), before, lambda x, at: F.when(x["start"] >= at, F.concat(part(at, x["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), part(F.element_at(ends, -1), F.char_length(text)))

        return let(running(F.transform(F.col(found), lambda x: x["end"]), F.greatest), whole)

    changed = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), built)
    return spans.withColumn(text_col, F.when(F.size(found) > 0, changed).otherwise(text)).select(*df.columns)

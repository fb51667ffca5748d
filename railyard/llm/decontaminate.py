"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space as single spaces. An item of m characters has an error budget
of k = rate * m edits and is split into k + 1 pieces: a passage within k edits of it holds one piece unchanged. All pieces
are looked for at once (Aho-Corasick); around each hit, the stretch in which the item could then lie is searched with
Myers' bit-parallel algorithm for the smallest edit distance to any of its substrings. Short items have short pieces, which
are hit more often; nothing is left out for that. Items of less than 1 / rate characters have no budget and must occur as
they are.

The items go to the workers in blocks of `block_chars` characters and less than one item more, as few as that takes: one pass
over the documents for each block, with a checkpoint between two, so neither driver nor workers hold much more than a block.
A worker keeps the matcher of its block from task to task. The result doesn't depend on the blocks.

Cases: null texts, and items that have no id, no text or only white space, match nothing; items with the same text all
match; several texts of one item id are matched each, and the best (distance, budget, end) counts; repeated documents are
matched each; very long texts are read whole, in memory that grows with the text and its hits; ids may be of any type and
null in documents; other columns are left out by find() and kept by clean(), whatever their names; an empty table on either
side gives no matches.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from railyard.llm.frames import arrow_map, checkpointed, fresh, sole_cache

RATE, BLOCK_CHARS = 0.05, 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = RATE) -> int:
    return int(rate * m)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece) of k + 1 pieces as even as can be."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


class Myers:
    """Smallest edit distance of a pattern to the substrings of a text."""

    def __init__(self, pattern: str):
        self.m, self.full, self.high = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
        self.equal: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.equal[c] |= 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end of the first best substring)."""
        up, down, score, best, end = self.full, 0, self.m, self.m, 0
        equal, full, high = self.equal.get, self.full, self.high
        for i, c in enumerate(text, 1):
            eq = equal(c, 0)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = down | ~(across | up) & full
            minus = up & across
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < best:
                    best, end = score, i
            plus, minus = plus << 1 & full, minus << 1 & full
            up = minus | ~(vertical | plus) & full
            down = plus & vertical
        return best, end


@dataclass
class Matcher:
    """All items of a block."""

    items: list[tuple[object, str]]  # id, normalised text

    rate: float = RATE

    def __post_init__(self):
        self.budgets = [budget(len(t), self.rate) for _, t in self.items]
        self.patterns: dict[int, Myers] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, self.budgets[n]):
                where[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def matches(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, distance, budget, end in the normalised text) of each item that the text holds."""
        if not self.any or not text:
            return []
        text = normalise(text)
        stretches: dict[int, list[list[int]]] = defaultdict(list)
        exact: dict[int, int] = {}
        for last, (length, places) in self.automaton.iter(text):
            for n, at in places:
                k, start = self.budgets[n], last + 1 - length - at
                if k == 0:
                    exact.setdefault(n, last + 1)  # the piece is the item
                    continue
                a, b = max(0, start - k), start + len(self.items[n][1]) + k
                own = stretches[n]
                # hits come in text order of their ends, those of one item nearly in order of their starts
                if own and own[-1][0] <= a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = [(n, 0, end) for n, end in exact.items()]
        for n, own in stretches.items():
            if n not in self.patterns:
                self.patterns[n] = Myers(self.items[n][1])
            distance, end = min((d, a + e) for a, b in own for d, e in [self.patterns[n].search(text[a:b])])
            if distance <= self.budgets[n]:
                found.append((n, distance, end))
        best: dict[object, tuple[int, int, int]] = {}
        for n, distance, end in found:
            item, own_best = self.items[n][0], (distance, self.budgets[n], end)
            best[item] = min(best.get(item, own_best), own_best)
        return [(item, *x) for item, x in sorted(best.items())]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The different items in ceil(characters / block_chars) blocks at most: an item is in the block that its first character falls in, if all stand one behind the other; blank ones, which cost none, stay out."""
    given = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).dropna().filter(F.trim("text") != "").distinct()
    total = given.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if total <= block_chars:
        yield [(r[0], r[1]) for r in given.collect()]
        return
    # places within parts of about half a block, and the characters before each part
    given = checkpointed(given.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(-(-2 * total // block_chars)))).withColumn("n", F.char_length("text")))
    sizes = given.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # two rows for each block
    place = F.sum("n").over(Window.partitionBy("part").orderBy("item", "text")) - F.col("n") + F.col("ahead")
    placed = checkpointed(given.join(F.broadcast(ahead), "part").withColumn("block", F.floor(place / block_chars)))
    for r in placed.select("block").distinct().orderBy("block").collect():
        yield [(x[0], x[1]) for x in placed.filter(F.col("block") == r[0]).select("item", "text").collect()]


#: The matcher of this Python worker's block.
_MATCHERS: dict[str, Matcher] = {}


def _mark(docs: DataFrame, items: list[tuple[object, str]], kind: T.DataType, text_col: str, into: str, rate: float) -> DataFrame:
    """Adds the matches of one block of items, whose ids are of the kind: an array of (item_id, distance, budget, end)."""
    shared, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    at = docs.columns.index(text_col)
    match = T.StructType([T.StructField("item_id", kind), *(T.StructField(c, T.LongType()) for c in ("distance", "budget", "end"))])
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(match))])
    arrow = to_arrow_type(T.ArrayType(match))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(_MATCHERS)
        if token not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[token] = Matcher(shared.value, rate)
        own = _MATCHERS[token]
        for batch in batches:
            hits = [[dict(zip(match.names, m, strict=True)) for m in own.matches(x)] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, arrow)], names=schema.names)

    return arrow_map(docs, kernel, schema)


def _normalised(block: list[tuple[object, str]]) -> list[tuple[object, str]]:
    return sorted({(i, t) for i, x in block if (t := normalise(x))})


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (id_col, item_id, distance, budget, end) for each document and item in it; end is in the normalised text."""
    kind, best = benchmark.schema[item_col].dataType, ("distance", "budget", "end")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    out = None
    for k, block in enumerate(blocks(benchmark, item_col, item_text_col, block_chars)):
        marked = _mark(slim, _normalised(block), kind, "body", "hits", rate).filter(F.size("hits") > 0)
        marked = marked.select("id", F.md5("body").alias("key"), F.lit(k).alias("block"), F.inline("hits"))
        out = marked if k == 0 else checkpointed(out.unionByName(marked))
    if k == 0:
        return out.select(F.col("id").alias(id_col), "item_id", *best)
    # a document may hold texts of one item in several blocks; equal rows of a document are counted, each gets its own row
    per = out.groupBy("id", "key", "item_id", "block").agg(F.min(F.struct(*best)).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("id", "key", "item_id").agg(F.min("m").alias("m"), F.max("n").alias("n"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(F.col("id").alias(id_col), "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, whole and with all their columns."""
    hits, kind = fresh("hits", docs.columns), benchmark.schema[item_col].dataType
    for k, block in enumerate(blocks(benchmark, item_col, item_text_col, block_chars)):
        docs = checkpointed(docs) if k else docs
        docs = _mark(docs, _normalised(block), kind, text_col, hits, rate).filter(F.size(hits) == 0).drop(hits)
    return docs

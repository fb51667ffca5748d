"""Token counts of greedy longest-match word pieces, in one pass over each word.

The trie holds the pieces that begin a word and, below a root of their own, those that go on in one. Each node has a
failure link and the number of pieces that following it pops: where a character doesn't continue the trie, the automaton
adds that number and goes on at the link's node, so that each character is looked at once and no piece is built. A word
that pieces can't cover is one unknown token, as with the usual greedy matcher.

Cases: null text is the empty text and has no tokens; very long texts and words are read whole, in time that grows with
their length; repeated rows are counted each; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from railyard.llm.frames import arrow_map, sole_cache

#: Chunks between white space whose counts a Python worker remembers, and the longest of them.
CACHED, CACHE_CHARS = 250_000, 48
#: A word: letters and digits with marks, or one other visible character.
WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]")


class LongestMatch:
    def __init__(self, first: Iterable[str], later: Iterable[str]):
        """first: pieces that begin a word; later: pieces inside one."""
        self.next: list[dict[str, int]] = [{}, {}]  # 0: root, 1: root of the later pieces
        final = set()
        for root, pieces in enumerate((first, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                if piece:
                    final.add(node)
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                if node in final:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    at, pops = self.link[parent], self.popped[parent]
                    while at >= 0 and c not in self.next[at]:
                        pops += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.next[at][c], pops
                queue.append(node)

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if they can't cover it."""
        node, total = 0, 0
        for c in word:
            while (to := self.next[node].get(c)) is None:
                if self.link[node] < 0:
                    return 0
                total += self.popped[node]
                node = self.link[node]
            node = to
        while node != 1:
            if self.link[node] < 0:
                return 0
            total += self.popped[node]
            node = self.link[node]
        return total


def model_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece model: those with the mark of a word's begin, and the others."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [own.id_to_piece(i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
    return [p[1:] for p in plain if p.startswith("▁")], [p for p in plain if not p.startswith("▁")]


class _Chunks(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: str) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a chunk."""
        counts = [self.automaton.count(w) for w in WORD.findall(chunk)]
        unknown = counts.count(0)
        found = (len(counts), sum(counts) + unknown, unknown)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = found
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> _Chunks:
    return _Chunks(LongestMatch(*model_pieces(path)))


def count_tokens(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_tokens and n_unknown (long). It replaces columns of these names."""
    names = ("n_words", "n_tokens", "n_unknown")
    df = df.drop(*(c for c in names if c != text_col))
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counter(model)
        sole_cache(chunks)
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                found = list(map(chunks.__getitem__, text.split())) if text else []
                rows.append(tuple(map(sum, zip(*found, strict=True))) if found else (0, 0, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=schema.names)

    return arrow_map(df, kernel, schema)

"""BPE encoding and decoding.

A word becomes a doubly linked list of symbols. A heap holds the rank of every adjacent pair that the merge table knows;
the lowest rank merges first (the leftmost of equals), and heap entries whose symbols have changed since are skipped.
Decoding joins the vocabulary's strings.

The vocabulary file is one in the `tokenizers` JSON format with a BPE model, byte-level alphabet, word-end suffix,
NFC + white space + lower case normalisation and a removing split; its path is a parameter and the file is only read.

Cases: null text is the empty text; empty or blank texts give no ids and the decoded text ""; the strings of added tokens
in a text become their ids (a vocabulary whose added tokens ask for more than that is refused); very long texts are encoded
whole, word by word; repeated rows are encoded each; an empty table gives no rows; other columns are carried along untouched.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from os.path import commonprefix
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from railyard.llm.frames import Held, arrow_map, sole_cache

#: White-space chunks and pre-tokens whose encoding a Python worker remembers, and the longest that it remembers.
CACHED_CHUNKS, CACHED_PIECES, CACHE_CHARS = 150_000, 300_000, 48

#: Control characters that str.split() takes as white space and the tokenizer's \s doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Word -> (ids as little-endian bytes); words are encoded as they are first met."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class BpeCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank of a pair of ids, keyed left * 2^32 + right; id that the pair of each rank becomes.
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if odd := [x["content"] for x in spec["added_tokens"] if any(x[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))]:
            raise ValueError(f"added tokens with options that this codec doesn't have: {odd}")
        #: What all added tokens begin with: texts without it need no search.
        self._mark = commonprefix(list(self.added))
        self.strings = dict((i, s) for s, i in self.vocab.items()) | {i: s for s, i in self.added.items()}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"])
        self._odd = regex.compile(f"[{SEPARATORS}]")
        self._spaces = regex.compile(rf"[^\S{SEPARATORS}]+")
        alphabet = byte_alphabet()
        self._inner = [self.vocab[c] for c in alphabet]
        self._last = [self.vocab[c + self.suffix] for c in alphabet]
        self._chunk_ids, self._piece_ids = _Words(self._encode_chunk, CACHED_CHUNKS), _Words(self._encode_piece, CACHED_PIECES)

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token. A heap entry is rank * 2^32 + position of the left symbol."""
        raw, ranks, merged = piece.encode("utf-8"), self.ranks, self.merged
        ids = [self._inner[b] for b in raw]
        ids[-1] = self._last[raw[-1]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        current = [ranks.get(ids[i] << 32 | ids[i + 1], -1) for i in range(n - 1)]  # rank of each symbol's pair with the next
        current.append(-1)
        heap = [r << 32 | i for i, r in enumerate(current) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if current[i] != rank:
                continue  # stale: one of the two has been merged meanwhile
            j = after[i]
            ids[i] = new = merged[rank]
            ids[j] = current[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                current[i] = r = ranks.get(new << 32 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                current[i] = -1
            if (h := before[i]) >= 0:
                current[h] = r = ranks.get(ids[h] << 32 | new, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _encode_piece(self, piece: str) -> bytes:
        return pack(f"<{len(ids := self.merge(piece))}I", *ids)

    def _encode_chunk(self, chunk: str) -> bytes:
        pieces = self._pieces.findall(chunk)
        return self._piece_ids[pieces[0]] if len(pieces) == 1 else b"".join(map(self._piece_ids.__getitem__, pieces))

    def _encode_plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # lower() alone would know the sigma at the end of a word
        chunks = self._spaces.split(text) if self._odd.search(text) else text.split()
        return b"".join(map(self._chunk_ids.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._added is None or self._mark not in text:
            return self._encode_plain(text)
        return b"".join(np.array([self.added[x]], dtype="<u4").tobytes() if x in self.added else self._encode_plain(x) for x in self._added.split(text) if x)

    def decode(self, ids: bytes | None) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One for each Python worker."""
    return BpeCodec(path)


#: The codecs themselves; a worker lets go of them when it turns to another operator.
CODECS = Held(codec.cache_clear)


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """Adds ids_col (binary: little-endian unsigned 32-bit ids) and count_col (long); with decoded_col also what decode() makes of the ids, in the same pass and so without a second Python worker. It replaces columns of these names."""
    more = [T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    df = df.drop(*(f.name for f in more))
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, *more])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        sole_cache(own._chunk_ids, own._piece_ids, CODECS)
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(at).to_pylist()]
            arrays = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded_col:
                arrays.append(pa.array([own.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return arrow_map(df, kernel, schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds text_col: the vocabulary strings of ids_col, with a space between two."""
    df = df.drop(text_col)
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(x) for x in batch.column(at).to_pylist()], pa.string())], names=schema.names)

    return arrow_map(df, kernel, schema)

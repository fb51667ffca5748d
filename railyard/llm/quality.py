"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 low quality, 1 good but toxic, 2 good. One weight vector over hashed text features is shared by all
grades; ordered thresholds cut the score: P(grade >= g) = sigmoid(score - threshold[g]). From it come the expected grade
and the tail probability that selection uses.

Features of a text, hashed into BUCKETS: percent of its tokens that are a word (lower case, without marks at the ends) or
begin as one, and bins of the shares of each kind of token (capitals, symbols, digits, tables, ...), of immediate repeats
and of different words. All text is read.

The model is fitted on the driver on a bounded sample: of each grade the `per_grade` labelled documents with the smallest
hash of the id, as sparse features (at most 2 * per_grade * GRADES * BUCKETS numbers). Everything is deterministic.

Cases: null text is the empty text; labels with nulls are left out; several labels of one document count as the worst;
with fewer than two grades in the sample all weights are zero and the thresholds tell the grades' shares (with no labels
at all the tail probability is 1 and the expected grade the best); very long texts are read whole; ids may be of any type
that documents and labels share; repeated rows are scored each; an empty table gives no rows; columns go along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm.frames import arrow_map, fresh, sole_cache

BUCKETS, PER_GRADE, GRADES = 1 << 17, 2000, 3
#: Documents of the sample that a feature must occur in to get a weight: rarer ones only tell single documents apart.
LEAST = 12
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”’…–—"
KINDS = 16
#: Letters of a word's begin, a feature beside the word itself.
BEGIN = 5
#: A feature counts up to so many percent of the tokens.
MOST = 3.0
#: Upper ends of the bins for shares of tokens.
BINS = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
CACHED, CACHE_CHARS = 120_000, 48
#: Selection keeps documents whose probability of the best grade is at least this.
KEEP = 0.5


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def kind_of(token: str) -> int:
    """A small number for what a token looks like."""
    bare = token.strip(EDGE)
    if not bare:
        return 1 if token == "|" else 2
    ends = len(token) - len(token.rstrip(EDGE))
    if ends >= 2:
        return 3 if bare.isupper() else 4
    if bare.isupper() and len(bare) > 1:
        return 5
    if bare.isdigit():
        return 6
    if any(c.isdigit() for c in bare):
        return 7
    if any(not c.isalpha() and c not in "'’-" for c in bare):
        return 8
    if len(bare) > 25:
        return 9
    if bare[0].isupper():
        return 10 if ends else 11
    return 12 if ends else 13


class _Tokens(dict):
    """Token -> buckets of its word and of the word's begin, and its kind, in one number."""

    def __missing__(self, token: str) -> int:
        word = token.strip(EDGE).lower()
        found = (_bucket("w " + word) * BUCKETS + _bucket("b " + word[:BEGIN])) * KINDS + kind_of(token)
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[token] = found
        return found


_TOKENS = _Tokens()
_BINNED = [[_bucket(f"k {kind} {b}") for b in range(len(BINS) + 1)] for kind in range(KINDS + 2)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features and their values: percent of the tokens, or 1 for a bin."""
    tokens = (text or "").split()
    codes = np.fromiter(map(_TOKENS.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    n = max(1, len(codes))
    pairs = codes // KINDS
    found, counts = np.unique(np.concatenate([pairs // BUCKETS, pairs % BUCKETS]), return_counts=True)
    shares = np.bincount(codes % KINDS, minlength=KINDS) / n
    repeats = np.count_nonzero(codes[1:] == codes[:-1]) / n
    variety = len(np.unique(pairs)) / n
    binned = [_BINNED[k][int(np.searchsorted(BINS, x))] for k, x in enumerate([*shares, repeats, variety])]
    return np.concatenate([found, binned]), np.concatenate([np.minimum(counts * (100 / n), MOST), np.ones(len(binned))])


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 1, 2, ...

    def tails(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ..."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds - self.weights[found[0]] @ found[1]))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int = GRADES, epochs: int = 300, rate: float = 0.3, decay: float = 1e-4, sparse: float = 1e-3, least: int = LEAST) -> Ordinal:
    """Full-batch proximal AdaGrad on the mean log loss of all tails, with an L1 (sparse) and an L2 penalty (decay); grades count alike however frequent they are."""
    weights, y = np.zeros(BUCKETS), np.array(grades, dtype=np.int64)
    counts = np.bincount(y, minlength=n_grades)
    if np.count_nonzero(counts) < 2:
        above = np.array([counts[g:].sum() / counts.sum() if counts.sum() else 1.0 for g in range(1, n_grades)])
        return Ordinal(weights, np.where(above >= 1, -np.inf, np.where(above <= 0, np.inf, 0.0)))
    often = np.zeros(BUCKETS, dtype=np.int32)
    for found, _ in rows:
        often[found] += 1
    often = often >= least
    kept = [often[found] for found, _ in rows]  # before anything is put together, so that rare features take no memory
    flat = np.concatenate([r[0][k] for r, k in zip(rows, kept, strict=True)]).astype(np.intp)
    value = np.concatenate([r[1][k] for r, k in zip(rows, kept, strict=True)]).astype(np.float32)
    row = np.repeat(np.arange(len(rows)), [np.count_nonzero(k) for k in kept])
    share = 1 / (np.count_nonzero(counts) * counts[y])
    target = (y[:, None] >= np.arange(1, n_grades)).astype(float)
    first, gaps = -0.5, np.full(n_grades - 2, 0.0)  # threshold[g + 1] = threshold[g] + exp(gap)
    seen_w, seen_t = np.full(BUCKETS, 1e-8), np.full(n_grades - 1, 1e-8)
    for _ in range(epochs):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights[flat] * value, minlength=len(rows))
        error = (1 / (1 + np.exp(cuts - score[:, None])) - target) * share[:, None]
        grad = np.bincount(flat, error.sum(1)[row] * value, minlength=BUCKETS) + decay * weights
        seen_w += grad**2
        pace = rate / np.sqrt(seen_w)
        weights -= pace * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * sparse, 0)
        by_cut = -error.sum(0)
        step = np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))]])
        seen_t += step**2
        move = rate * step / np.sqrt(seen_t)
        first -= move[0]
        gaps -= move[1:]
    return Ordinal(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> Ordinal:
    """Fits on documents (doc_id, text) and labels (doc_id, quality, toxic)."""
    graded = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    graded = graded.select("doc_id", F.when(F.col("q") < 1, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))
    picked = [r for g in range(GRADES) for r in graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade).collect()]
    spark = docs.sparkSession
    kind = labels.schema["doc_id"].dataType
    chosen = spark.createDataFrame([(r["doc_id"], r["grade"]) for r in picked], T.StructType([T.StructField("doc_id", kind), T.StructField("grade", T.IntegerType())]))  # per_grade * GRADES rows at most
    # one text of each document: repeated rows would count the same label again
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(_TOKENS)
        for batch in batches:
            found = [np.stack(features(x)).astype(np.float32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "grade", "found"])

    schema = T.StructType([sample.schema["doc_id"], T.StructField("grade", T.IntegerType()), T.StructField("found", T.BinaryType())])
    made = arrow_map(sample, kernel, schema).groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("found").alias("found"))
    rows = sorted(made.collect(), key=lambda r: r["doc_id"])
    arrays = [np.frombuffer(r["found"], dtype=np.float32).reshape(2, -1) for r in rows]
    return fit([(x[0].astype(np.int32), x[1]) for x in arrays], [r["grade"] for r in rows])


def score(df: DataFrame, model: Ordinal, text_col: str = "text", grade_col: str = "expected_grade", tail_col: str = "p_good") -> DataFrame:
    """Adds grade_col, the expected grade, and tail_col, P(grade is the best one); replaces columns of these names."""
    df = df.drop(grade_col, tail_col)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(grade_col, T.DoubleType()), T.StructField(tail_col, T.DoubleType())])
    used = np.flatnonzero(model.weights)
    shared = df.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.thresholds))  # at most BUCKETS weights

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values, thresholds = shared.value
        weights = np.zeros(BUCKETS)
        weights[index] = values
        own = Ordinal(weights, thresholds)
        sole_cache(_TOKENS)
        for batch in batches:
            tails = [own.tails(features(x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[-1]) for t in tails], pa.float64())], names=schema.names)

    return arrow_map(df, kernel, schema)


def select(df: DataFrame, model: Ordinal, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows whose probability of the best grade is at least `keep`, with their own columns."""
    grade, tail = fresh("expected_grade", df.columns), fresh("p_good", df.columns)
    return score(df, model, text_col, grade, tail).filter(F.col(tail) >= keep).select(*df.columns)

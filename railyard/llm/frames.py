"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A kernel sees at most so many bytes or rows of a batch at a time; a single longer row is a piece of its own. Spark's own
#: batches are bounded by bytes as well (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default).
PIECE_BYTES, PIECE_ROWS = 1 << 20, 1024


class Held:
    """Something that a Python worker holds on to until it is cleared, as a cache is."""

    def __init__(self, clear: Callable[[], None]):
        self.clear = clear


#: Word caches of this Python worker, and what else it holds.
_CACHES: list[dict | Held] = []


def sole_cache(*own: dict | Held) -> None:
    """Empties the caches of other operators: workers are reused, and one stage's words are of no use to the next. Memory goes back to the machine."""
    others = [cache for cache in _CACHES if not any(cache is x for x in own)]
    _CACHES[:] = own
    for cache in others:
        cache.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *taken: Iterable[str]) -> str:
    """The name, with as many underscores more as it takes to clash with none of the taken ones (in any case of letters)."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PIECE_BYTES and PIECE_ROWS, or of one row."""
    for batch in batches:
        rest = [batch]
        while rest:
            now = rest.pop()
            if now.num_rows > 1 and (now.num_rows > PIECE_ROWS or now.nbytes > PIECE_BYTES):
                half = now.num_rows // 2
                rest += [now.slice(half), now.slice(0, half)]
            else:
                yield now


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches in pieces small enough for long texts, whatever the session's settings are."""
    return df.mapInArrow(lambda batches: kernel(pieces(batches)), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode only, where none is set."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_out(df: DataFrame) -> str:
    """Writes the rows as Parquet to the shared folder; the path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what write_out() wrote, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

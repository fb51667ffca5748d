"""Iteration: cutting the lineage between rounds."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class NotConverged(RuntimeError):
    """A loop used up its rounds before its result was there."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode only, where none is set."""
    context = spark.sparkContext
    if given := context.getConf().get("spark.checkpoint.dir"):
        return given
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rounds(start: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, every: int = 4) -> DataFrame:
    """step() n times, with a cut each few rounds."""
    state = cut(start)
    for k in range(1, n + 1):
        state = step(state)
        if k % every == 0 and k < n:
            state = cut(state)
    return state


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame], most: int = 10_000, every: int = 1) -> DataFrame:
    """step() until changed(old, new) has no rows; NotConverged after `most` rounds. Each `every` rounds end in a cut and a look."""
    state = cut(start)
    for _ in range(0, most, every):
        new = state
        for _ in range(every):
            new = step(new)
        new = cut(new)
        if changed(state, new).isEmpty():
            return new
        state = new
    raise NotConverged(f"still changing after {most} rounds")

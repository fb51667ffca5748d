"""Results and caches: Parquet for tables that are read again, CSV and JSON for people."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, made and written first if it isn't there. Works for any store that Spark can write to."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if force or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def result(path: str, values: dict) -> None:
    """A small dictionary of figures."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, indent=1, default=float, sort_keys=True))

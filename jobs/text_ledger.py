"""Ledger of source texts: which texts a study was made of, by digest, what came or changed since, and which sources repeat each other.

    python -m jobs.text_ledger --table documents=PATH --table pages=PATH --out FOLDER [--config jobs/text_ledger.json]

Results are only worth something if one can tell which inputs they were made of. For each table the job keeps
* `ledger/name=.../grp=...`: each different (id, text) once: source, SHA-256, characters, lines, time of its file;
* `sources/name=.../grp=...`: by source, of the newest text of each id: texts, different ones, those that another source has
  as well, characters, and their share of the group;
* `marks/name=...`: the newest file time taken.

A run reads files from the mark on (Spark leaves older files unread by their metadata), adds what the ledger doesn't have,
and works out the groups that it read anew. Files of the very time of the mark are read again and add nothing. A run that was
broken off is made good by the next one: the mark comes last, and rows that are there aren't added again. Running it again
without new files leaves everything as it was.

Null texts are empty texts; rows alike in id and text are one; a text that goes back to an earlier one is no new entry and
its newest entry stays the other one; ids are kept as strings; rows without id are told apart by their texts; an id that
changes its group is a new one there; null groups are "" and null sources too.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.sources import sinks

LOG = logging.getLogger("text_ledger")
CONFIG = Path(__file__).with_suffix(".json")
LEDGER = "id string, source string, sha256 string, n_chars long, n_lines long, modified timestamp, name string, grp string"
SOURCES = "source string, n_texts long, n_different long, n_elsewhere long, n_chars long, share double, name string, grp string"
MARKS = "mark timestamp, name string"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet. Partitions of the empty string come back as null."""
    try:
        found = spark.read.schema(schema).parquet(path)
        return found.fillna("", subset=["grp"]) if "grp" in found.columns else found
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def named(columns: dict[str, str], name: str) -> Column:
    """A column of the config file; null is the empty string."""
    return F.coalesce(F.expr(columns[name]).cast("string"), F.lit(""))


def entries(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One entry for each different (group, id, text), with the time of the earliest file that has it. Only digests are shuffled."""
    text = named(columns, "text")
    own = rows.select(
        F.expr(columns["id"]).cast("string").alias("id"), named(columns, "source").alias("source"), F.sha2(text, 256).alias("sha256"), F.char_length(text).cast("long").alias("n_chars"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.col("_metadata.file_modification_time").alias("modified"), named(columns, "grp").alias("grp"),
    )
    return own.groupBy("grp", "id", "sha256").agg(F.min("source").alias("source"), F.max("n_chars").alias("n_chars"), F.max("n_lines").alias("n_lines"), F.min("modified").alias("modified"))


def by_source(ledger: DataFrame) -> DataFrame:
    """Figures of each source from the newest text of each id (of equals the largest digest)."""
    keys = ["name", "grp"]
    newest = ledger.filter("id is not null").groupBy(*keys, "id").agg(F.max(F.struct("modified", "sha256", "source", "n_chars")).alias("t")).select(*keys, "t.*")
    newest = newest.unionByName(ledger.filter("id is null").select(*newest.columns))
    # one row for each text of a source, so that a text that half of all rows have is small
    held = newest.groupBy(*keys, "source", "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    spread = held.groupBy(*keys, "sha256").agg(F.count(F.lit(1)).alias("sources"))
    made = held.join(spread, [*keys, "sha256"]).groupBy(*keys, "source").agg(
        F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_different"), F.sum(F.when(F.col("sources") > 1, F.col("n")).otherwise(0)).alias("n_elsewhere"), F.sum("n_chars").alias("n_chars")
    )
    whole = made.groupBy(*keys).agg(F.sum("n_chars").alias("all"))
    return made.join(whole, keys).select("source", "n_texts", "n_different", "n_elsewhere", "n_chars", F.coalesce(F.try_divide(F.col("n_chars"), F.col("all")), F.lit(0.0)).alias("share"), *keys)


def take(spark: SparkSession, name: str, path: str, out: str, columns: dict[str, str]) -> int:
    """Takes what is new of one table; how many entries were added."""
    mark = read(spark, f"{out}/marks", MARKS).filter(F.col("name") == name).agg(F.max("mark")).first()[0]
    rows = spark.read.parquet(path)
    time = F.col("_metadata.file_modification_time")
    if mark is not None:
        rows = rows.filter(time >= F.lit(mark))
    seen = read(spark, f"{out}/ledger", LEDGER).filter(F.col("name") == name)
    touched = [r[0] for r in rows.select(named(columns, "grp")).distinct().collect()]  # a row for each group, as for each partition that is written
    same = lambda a, b: a["grp"].eqNullSafe(b["grp"]) & a["id"].eqNullSafe(b["id"]) & (a["sha256"] == b["sha256"])
    told = seen.filter(F.col("grp").isin(touched)).select("grp", "id", "sha256")
    own = entries(rows, columns)
    new = own.join(told, same(own, told), "left_anti").withColumn("name", F.lit(name))
    before = seen.count()
    new.select("id", "source", "sha256", "n_chars", "n_lines", "modified", "name", "grp").write.mode("append").partitionBy("name", "grp").parquet(f"{out}/ledger")

    ledger = read(spark, f"{out}/ledger", LEDGER).filter(F.col("name") == name)
    added = ledger.count() - before
    replace = lambda df, table, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{table}")
    replace(by_source(ledger.filter(F.col("grp").isin(touched))), "sources", "name", "grp")
    if touched:
        replace(rows.agg(F.max(time).alias("mark")).withColumn("name", F.lit(name)), "marks", "name")
    LOG.info("%s: files of %s from %s on; %d entries added, groups %s worked out", name, path, mark or "the beginning", added, ", ".join(sorted(touched)[:40]))
    return added


def run(spark: SparkSession, tables: dict[str, str], out: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new of the tables (name -> path); entries added by table. A CSV of the groups, for people, is written anew."""
    config, out = config or json.loads(CONFIG.read_text()), out.rstrip("/")
    added = {name: take(spark, name, path, out, config["tables"][name]) for name, path in tables.items()}
    groups = read(spark, f"{out}/sources", SOURCES).groupBy("name", "grp").agg(F.count(F.lit(1)).alias("sources"), *(F.sum(c).alias(c) for c in ("n_texts", "n_different", "n_elsewhere", "n_chars")))
    sinks.csv(groups.orderBy("name", "grp"), f"{out}/groups", single=True)  # a row for each group
    return added


def result(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, sources) as they stand."""
    return read(spark, f"{out.rstrip('/')}/ledger", LEDGER), read(spark, f"{out.rstrip('/')}/sources", SOURCES)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.text_ledger", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--table", action="append", required=True, help="name=path, for names of the config file")
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_ledger").getOrCreate()
    try:
        run(spark, dict(t.split("=", 1) for t in given.table), given.out, json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

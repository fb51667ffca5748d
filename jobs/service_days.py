"""Service figures by day from logs of departures that keep arriving: what ran, how often and how regularly, and which stops follow one another.

    python -m jobs.service_days --events FOLDER --out FOLDER [--checkpoint FOLDER] [--config jobs/service_days.json]

A file stream takes the files that have come since the last run and ends (availableNow). Each batch goes to
`visits/day=.../batch=...`; the days it has rows of are then worked out anew from all their visits and replace their
partitions of `hours` (departures, trips, headways and their CV^2 by day, hour and stop) and `edges` (median time and
distance by day and pair of stops). So late visits of an earlier day are counted, and a batch that is run again writes the
same partitions again. Visits that arrive twice (same id) count once. The checkpoint belongs to the output: either is of no
use without the other, and without new files nothing is written.

Visits without time, trip or stop are left out. A vehicle's visits of a day are put in order in one task, and so are the
departures of a stop in an hour.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.functions.scalar import effective_rate
from railyard.operators import edges

LOG = logging.getLogger("service_days")
CONFIG = Path(__file__).with_suffix(".json")
HOUR_S = 3600.0
DAY_SCHEMA = "day date, batch long"
HOURS = "hour int, stop string, departures long, trips long, mean_gap double, cv2 double, rate double, day date"
EDGES = "i string, j string, n long, tau_s double, dist_m double, day date"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def visits(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(id, trip, stop, time, dist, day) of the log's rows that say when which vehicle was where; times in whole seconds, as in timetables."""
    time = F.date_trunc("second", F.col(columns["time"]).cast("timestamp_ntz")).cast("timestamp_ntz")
    own = rows.select(
        F.col(columns["id"]).cast("string").alias("id"), F.col(columns["trip"]).cast("string").alias("trip"), F.col(columns["stop"]).cast("string").alias("stop"),
        time.alias("time"), F.col(columns["dist"]).cast("double").alias("dist"), F.to_date(time).alias("day"),
    )
    return own.dropna(subset=["trip", "stop", "time"])


def seconds(time: str, day: str) -> Column:
    """Seconds since the day began."""
    return F.expr(f"cast(timestampdiff(SECOND, cast({day} AS timestamp_ntz), {time}) AS double)")


def seen_once(own: DataFrame) -> DataFrame:
    """One visit for each id of a day, the earliest of those that differ; visits without id as they are."""
    first = own.filter("id is not null").groupBy("day", "id").agg(F.min(F.struct("time", "trip", "stop", "dist")).alias("v")).select("day", "id", "v.*")
    return first.unionByName(own.filter("id is null").select(*first.columns))


def hours(own: DataFrame, first_hour: int, last_hour: int) -> DataFrame:
    timed = own.withColumn("dep_s", seconds("time", "day")).withColumn("hour", F.floor(F.col("dep_s") / HOUR_S).cast("int"))
    timed = timed.filter(edges.in_window("dep_s", first_hour * HOUR_S, last_hour * HOUR_S))
    keys = ["day", "hour", "stop"]
    gaps = edges.headway_irregularity(timed, keys).withColumnRenamed("n", "departures")
    trips = timed.groupBy(*keys).agg(F.countDistinct("trip").alias("trips"))
    made = gaps.join(trips, keys).withColumn("rate", effective_rate(F.col("departures") / HOUR_S, "cv2"))
    return made.select("hour", "stop", "departures", "trips", "mean_gap", "cv2", "rate", "day")


def day_edges(own: DataFrame) -> DataFrame:
    """Stops that follow one another in a vehicle's day; the day takes the place of the mode."""
    at = seconds("time", "day")
    given = own.select(F.col("day").alias("mode"), F.struct("day", "trip").alias("trip"), "stop", at.alias("arr_s"), at.alias("dep_s"), "dist", "id")
    found = edges.edge_stats(edges.consecutive(given, ("dep_s", "id", "stop")))
    return found.select("i", "j", "n", "tau_s", "dist_m", F.col("mode").alias("day"))


def take(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Adds a batch and works its days out anew. Running it again leaves the same tables."""
    spark = batch.sparkSession
    replace = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
    replace(visits(batch, config["columns"]).withColumn("batch", F.lit(number).cast("long")), "visits", "day", "batch")
    schema = "id string, trip string, stop string, time timestamp_ntz, dist double, " + DAY_SCHEMA
    landed = read(spark, f"{out}/visits", schema)
    mine = landed.filter(F.col("batch") == number).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each day of the batch
    LOG.info("batch %d: %d visits of %d days", number, sum(r["n"] for r in mine), len(mine))
    if not mine:
        return
    own = seen_once(landed.filter(F.col("day").isin([r["day"] for r in mine])))
    replace(hours(own, config["first_hour"], config["last_hour"]), "hours", "day")
    replace(day_edges(own), "edges", "day")
    LOG.info("batch %d: wrote hours and edges of %s", number, ", ".join(str(r["day"]) for r in sorted(mine, key=lambda r: r["day"])[:40]))


def globbed(path: str) -> str:
    """The path as a pattern that only it fits: a stream takes a single file by a pattern, but not by its name."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[]{}\\") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, events: str, out: str, checkpoint: str | None = None, config: dict | None = None) -> int:
    """Takes what is new below `events`; the number of visits read."""
    config = config or json.loads(CONFIG.read_text())
    out = out.rstrip("/")
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(globbed(events))
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, out, config))
        .option("checkpointLocation", checkpoint or f"{out}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    LOG.info("read %d rows of %s", taken, events)
    return taken


def result(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(hours, edges) as they stand."""
    return read(spark, f"{out.rstrip('/')}/hours", HOURS), read(spark, f"{out.rstrip('/')}/edges", EDGES)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.service_days", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--events", required=True, help="folder of Parquet files, or one file")
    parser.add_argument("--out", required=True)
    parser.add_argument("--checkpoint", help="by default below the output")
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("service_days").getOrCreate()
    try:
        run(spark, given.events, given.out, given.checkpoint, json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

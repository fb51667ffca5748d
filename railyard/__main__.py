"""python -m railyard build|simulate|resilience FEED --out FOLDER [--weekday DAY | --date YYYYMMDD]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from railyard.plans import chain, demand, modal, simulate
from railyard.sources import feed, sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="railyard", description=__doc__)
    parser.add_argument("command", choices=("build", "simulate", "resilience"))
    parser.add_argument("feed")
    parser.add_argument("--out", required=True)
    parser.add_argument("--weekday")
    parser.add_argument("--date")
    parser.add_argument("--method", choices=("law", "events", "leaps"), default="law")
    parser.add_argument("--people", type=float, default=demand.peak_riders())
    parser.add_argument("--horizon", type=float, default=900.0)
    parser.add_argument("--runs", type=int, default=10)
    parser.add_argument("--top", type=int, default=100)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("railyard").getOrCreate()
    net = modal.build(feed.load(spark, given.feed, weekday=given.weekday, date=given.date))
    if given.command == "build":
        net.edges.write.mode("overwrite").parquet(f"{given.out}/edges")
        net.nodes.write.mode("overwrite").parquet(f"{given.out}/nodes")
        return
    if given.command == "resilience":
        sinks.csv(modal.resilience(net, given.top), f"{given.out}/resilience", single=True)
        return
    prior = demand.service_prior(net.nodes, given.people).withColumnRenamed("stop", "node")
    start = chain.allocate(prior, net.nodes.select("mode", F.col("stop").alias("node")))
    q = net.generator()
    if given.method == "law":
        out = chain.transient(q, start.withColumnRenamed("n", "v"), given.horizon)
    elif given.method == "events":
        out = simulate.event_ensemble(q, start, given.horizon, given.runs)
    else:
        out = simulate.leap_ensemble(q, start, given.horizon, given.runs)
    out.write.mode("overwrite").parquet(f"{given.out}/{given.method}")


if __name__ == "__main__":
    main()

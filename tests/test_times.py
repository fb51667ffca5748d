from pyspark.sql import functions as F

from railyard.functions import scalar


def test_seconds_read_a_costly_text_once(spark):
    """Once where a filter by the seconds was pushed below, once where they are kept."""
    text = F.format_string("%02d:%02d:%02d", F.col("id") % 30, F.col("id") % 60, F.lit(5))
    df = spark.range(100).select(text.alias("time")).select(scalar.seconds_of("time").alias("s")).dropna(subset=["s"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") <= 2
    assert sorted(r.s for r in df.collect()) == sorted(k % 30 * 3600 + k % 60 * 60 + 5.0 for k in range(100))


def test_seconds_of_what_is_no_time(spark):
    given = ["25:00:01", " 07:05:09 ", "7:5", "", None, "a:b:c", "1:2:3:4", "0:0:1.5"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string").select("k", scalar.seconds_of("x").alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == [90001.0, 25509.0, None, None, None, None, None, 1.5]

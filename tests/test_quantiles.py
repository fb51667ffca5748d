from pyspark.sql import functions as F

from railyard.operators import stats
from railyard.queries import network


def test_quantiles_are_percentiles(spark):
    """Groups of one value, of ties, with nulls and without a key."""
    rows = [("a", float(k * 37 % 101)) for k in range(101)] + [("a", 5.0)] * 40 + [("b", 3.5), (None, 1.0), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = stats.quantiles(df, ["g"], "v", {"low": 0.05, "med": 0.5, "high": 0.9}, ranges=8)
    want = df.filter("v is not null").groupBy("g").agg(F.percentile("v", 0.05).alias("low"), F.percentile("v", 0.5).alias("med"), F.percentile("v", 0.9).alias("high"))
    plain = lambda d: sorted([(r.g, *(round(x, 9) for x in r[1:])) for r in d.collect()], key=repr)
    assert plain(got) == plain(want)


def test_no_task_holds_the_prices_of_a_group(spark):
    plan = network.weighted_quantiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_remainders_of_equal_totals_go_to_the_smaller_key(spark, tmp_path):
    """Two customers whose prices are the same in another order: sums of doubles differ in the last bit."""
    prices = [0.1, 0.2, 0.3, 1499.4]
    orders = [(k, c, x) for c, own in ((1, prices), (2, prices[::-1])) for k, x in enumerate(own)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0, "X"), (2, 0, "X")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    flipped = spark.createDataFrame([(k, 3 - c, x) for k, c, x in orders], "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1)
    flipped.write.parquet(f"{tmp_path}/flipped/orders.parquet")
    spark.read.parquet(f"{tmp_path}/customer.parquet").write.parquet(f"{tmp_path}/flipped/customer.parquet")
    own = [{r.o_custkey: r.whole for r in network.largest_remainder(spark, f"{tmp_path}{x}").collect()} for x in ("", "/flipped")]
    assert own == [{1: 2, 2: 1}] * 2


def test_equal_remainders_of_different_totals_go_to_the_smaller_key(spark, tmp_path):
    """In doubles the remainder of the second one is larger by the last bits."""
    spark.createDataFrame([(1, 1, 812300.0), (2, 2, 33300.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0, "X"), (2, 0, "X")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r.o_custkey: r.whole for r in network.largest_remainder(spark, str(tmp_path)).collect()} == {1: 813, 2: 33}

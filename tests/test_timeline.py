"""Timelines cut into ranges against the same timelines in one task each."""

import random

import pytest
from pyspark.sql import functions as F

from presage.operators import events, joins
from presage.operators.timeline import is_hot, running, shifted


def shown(df):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randint(0, 200), float(rng.randint(0, 50)), i) for i in range(1500)]
    return spark.createDataFrame(rows, "k int, ts int, close double, id int")


@pytest.fixture(scope="module")
def cuts(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(rng.choice([1, 1, 2, 3, None]), rng.randint(-5, 210), i % 40) for i in range(300)], "k int, cutoff int, n int")


def test_a_hot_key_is_found_and_spread(spark, prices):
    assert is_hot(prices, ["k"], 500) and not is_hot(prices, ["k"]) and not is_hot(prices.where("false"), ["k"], 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = prices.select(F.lit(1).alias("k"), "ts", "close", "id")
        dealt = one.repartitionByRange(4, "k", "ts", F.xxhash64(*one.columns)).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 4 and max(r["count"] for r in dealt) < 700
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_running_values(prices):
    order = [F.col("ts"), F.col("id")]
    specs = {"a": ("last", F.when(F.col("id") % 3 == 0, F.col("close"))), "b": ("max", F.when(F.col("id") % 4 == 0, F.struct("close", "id"))), "c": ("sum", F.col("id"))}
    assert shown(running(prices, ["k"], order, specs, True)) == shown(running(prices, ["k"], order, specs, False))


def test_row_offsets(prices):
    order = [F.col("ts"), F.col("id")]
    specs = {"next": (F.col("close"), 1), "far": (F.struct("id", "close"), 40), "before": (F.when(F.col("id") % 2 == 0, F.col("id")), -7)}
    assert shown(shifted(prices, ["k"], order, specs, True)) == shown(shifted(prices, ["k"], order, specs, False))


def test_lookups_and_event_studies(prices, cuts):
    dated = prices.dropDuplicates(["k", "ts", "close"]).select("k", F.timestamp_seconds("ts").alias("filed"), "close", "id")
    dates = cuts.select("k", F.timestamp_seconds("cutoff").alias("cutoff"), "n")
    apart = prices.withColumn("ts", F.col("ts") * 10_000 + F.col("id"))
    asked = cuts.withColumn("cutoff", F.col("cutoff") * 10_000)
    runs = [
        lambda n: joins.asof_backward(cuts, prices, "k", "cutoff", "ts", "close", "id", limit=n),
        lambda n: joins.asof_by(dates, dated, ["k"], "cutoff", "filed", "close", "id", limit=n),
        lambda n: joins.periods_back(dates, dated.withColumn("end", F.add_months("filed", F.col("id") % 30)), ["k"], "cutoff", "filed", "end", "id", 1, limit=n),
        lambda n: events.reactions(apart, asked, "k", "ts", "close", "cutoff", (1, 5, 20), limit=n),
        lambda n: events.momentum_volatility(apart, "k", "ts", "close", 60, 30, limit=n),
        lambda n: events.forward_return(apart, "k", "ts", "close", 20, 60, limit=n),
    ]
    for run in runs:
        assert shown(run(5)) == shown(run(None))

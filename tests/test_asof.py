"""As-of look-ups by blocks against pandas and brute force: skewed groups, ties, nulls, and how rows spread over tasks."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.operators import asof

START = datetime(2001, 1, 1)


def brute(asks, facts, largest):
    out = []
    for i, (by, at) in enumerate(asks):
        own = [(t, v) for b, t, v in facts if b == by and t is not None and v is not None and at is not None and t <= at]
        out.append((i, (max(v for _, v in own) if largest else max(own)[1]) if own else None))
    return out


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("weeks", [1, 13, 500])
def test_against_brute_force(spark, weeks, largest):
    rng = random.Random(weeks)
    moment = lambda: None if rng.random() < 0.03 else START + timedelta(hours=rng.randrange(0, 2000))
    group = lambda: rng.choice(["a", "a", "a", "b", None])
    facts = [(group(), moment(), None if rng.random() < 0.05 else float(rng.randrange(50))) for _ in range(300)] + [("c", START, 1.0), ("d", None, 1.0)]
    asks = [(group(), moment()) for _ in range(300)] + [("c", START - timedelta(1)), ("c", START), ("c", START + timedelta(9000)), ("e", START), ("d", START)]
    left = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(asks)], "i int, theme string, at timestamp_ntz")
    right = spark.createDataFrame(facts, "theme string, ts timestamp_ntz, price double")
    look = asof.largest_at_or_before if largest else asof.last_at_or_before
    found = look(left, right, "theme", "at", "ts", F.col("price"), "found", weeks)
    assert found.columns == ["i", "theme", "at", "found"]
    assert sorted((r.i, r.found) for r in found.collect()) == brute(asks, facts, largest)


def test_empty(spark):
    left = spark.createDataFrame([(1, "a", START)], "i int, theme string, at timestamp_ntz")
    right = spark.createDataFrame([], "theme string, ts timestamp_ntz, price double")
    assert asof.last_at_or_before(left, right, "theme", "at", "ts", F.col("price"), "found").first().found is None
    assert asof.last_at_or_before(left.limit(0), right, "theme", "at", "ts", F.col("price"), "found").count() == 0


def test_one_group_spreads_over_tasks(spark):
    """200,000 rows of one theme: right, and no task gets more than a block or two of them."""
    n, step = 200_000, 3600
    second = lambda c: F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + c).cast("timestamp_ntz")
    facts = spark.range(n).select(F.lit("one").alias("theme"), second(F.col("id") * step).alias("ts"), F.col("id").cast("double").alias("price"))
    asks = spark.range(n).select("id", F.lit("one").alias("theme"), second(F.col("id") * step + F.pmod(F.xxhash64("id"), F.lit(7 * step)) - 3 * step).alias("at"))
    found = asof.last_at_or_before(asks, facts, "theme", "at", "ts", F.col("price"), "found").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found.select("id", "at", "found", "task").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == n and got.groupby("task").size().max() < n / 5
    want = pd.merge_asof(got.sort_values("at"), facts.toPandas().sort_values("ts"), left_on="at", right_on="ts")
    assert (want["found"].fillna(-1) == want["price"].fillna(-1)).all()

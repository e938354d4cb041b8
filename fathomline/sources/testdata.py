"""Price panels made of the star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.expr import week_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_panel(spark: SparkSession, sf_dir: str, theme: str = "l_returnflag") -> DataFrame:
    """theme: a column of lineitem or, for p_brand, of part; security: the line number; value: 100 plus a thousandth of
    the week's mean unit price, at its last ship date; SPY: the same over all rows."""
    rows = table(spark, sf_dir, "lineitem")
    if theme == "p_brand":
        rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), rows.l_partkey == F.col("p_partkey"))
    rows = rows.select(
        F.col("l_shipdate").alias("date"), week_of(F.col("l_shipdate")).alias("week"), F.col(theme).alias("theme"), F.col("l_linenumber").cast("string").alias("security"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")
    )
    # sums by series first, so the market's mean needs no second pass over the lines
    each = rows.groupBy("week", "theme", "security").agg(F.max("date").alias("date"), F.sum("unit").alias("total"), F.count("unit").alias("n"))
    series = each.select("date", "theme", "security", (100.0 + F.col("total") / F.col("n") / 1000.0).alias("value"))
    market = each.groupBy("week").agg(F.max("date").alias("date"), (100.0 + F.sum("total") / F.sum("n") / 1000.0).alias("value"))
    return series.union(market.select("date", F.lit("__market__"), F.lit("SPY"), "value"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theme: the event's type, security: the user, row order: the event's number."""
    return table(spark, sf_dir, "events").select(F.col("ts").alias("date"), F.col("event_type").alias("theme"), F.col("user_id").cast("string").alias("security"), "value", "event_id")

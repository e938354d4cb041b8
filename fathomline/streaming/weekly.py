"""The last price of each week from a stream of observations, and the arrival guard, with Structured Streaming.

An extension: the batch operators are what defines results, and these give the same rows once the watermark has passed a week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_last_stream(rows: DataFrame, late: str = "7 days", min_value: float = 0.0) -> DataFrame:
    """week, theme, security, price of a stream (date, theme, security, value [, row_order]). A week closes when the watermark, `late` behind the newest date, is past its Friday.

    Weeks are tumbling windows of seven days that start on Saturdays.
    """
    order = F.col("row_order") if "row_order" in rows.columns else F.lit(0)
    own = rows.where(F.col("value") > min_value).select(F.col("date").cast("timestamp").alias("date"), F.trim("theme").alias("theme"), F.upper(F.trim("security")).alias("security"), "value", order.cast("bigint").alias("row_order"))
    week = F.window("date", "7 days", "7 days", "2 days")
    return (
        own.withWatermark("date", late)
        .groupBy(week.alias("_w"), "theme", "security")
        .agg(F.max_by("value", F.struct("date", "row_order", "value")).alias("price"))
        .select(F.date_sub(F.to_date("_w.end"), 1).alias("week"), "theme", "security", "price")
    )


def late_arrivals_stream(rows: DataFrame) -> DataFrame:
    """Rows that were available only after the day they describe."""
    return rows.where(F.col("feature_available_at").cast("timestamp") >= F.date_add(F.to_date("date"), 1).cast("timestamp"))

"""Metrics of each theme and week that all lanes read: relative strength, ranks, drawdown, next session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.expr import WINDOWS, before_now, percentile_rank, worst_fall
from fathomline.operators.panel import Panel


def theme_metrics(panel: Panel) -> DataFrame:
    """One row for each theme and week: the columns of panel.themes, with

    rs_Nw, relative_ratio_Nw, m0, m0_rank and m0_benchmark (over m0_window weeks), acceleration and its parts, rs_rank_Nw, acceleration_rank, max_drawdown_52w, effective_date.
    The calendar has one row for each week, so it is broadcast.
    """
    path = F.collect_list("theme_index").over(before_now(Window.partitionBy("theme").orderBy("week"), 52))
    themes = panel.themes.join(F.broadcast(panel.calendar), "week", "left")
    strength = themes.select("*", *(F.expr(f"t{w} - b{w} as rs_{w}w") for w in WINDOWS), F.when(F.size(path) == 52, worst_fall(path)).alias("max_drawdown_52w"))
    speed = {w: f"rs_{w}w / {w}D" for w in (4, 8, 13)}
    ratios = [f"try_divide(1D + t{w}, 1D + b{w}) - 1D as relative_ratio_{w}w" for w in WINDOWS]
    fast = strength.selectExpr("*", *ratios, f"{speed[4]} - {speed[8]} as accel_4v8", f"{speed[8]} - {speed[13]} as accel_8v13", f"{speed[4]} - {speed[13]} as early_acceleration")
    fast = fast.selectExpr("*", "0.60D * accel_4v8 + 0.40D * accel_8v13 as acceleration")
    n = panel.config.m0_window
    ranked = [percentile_rank(f"rs_{w}w", "week").alias(f"rs_rank_{w}w") for w in WINDOWS] + [percentile_rank(x, "week").alias(f"{x}_rank") for x in ("acceleration", "early_acceleration")]
    return fast.select("*", *ranked).selectExpr("*", f"rs_{n}w as m0", f"rs_rank_{n}w as m0_rank", f"b{n} as m0_benchmark")


def relative_strength(panel: Panel) -> DataFrame:
    """Which themes have positive strength over m0_window weeks against the benchmark each Friday, and where they rank."""
    n = panel.config.m0_window
    out = panel.themes.join(F.broadcast(panel.benchmark), "week", "left").selectExpr("week", "theme", f"t{n} - b{n} as m0")
    return out.select("week", "theme", "m0", percentile_rank("m0", "week").alias("m0_rank"), F.coalesce(F.col("m0") > 0, F.lit(False)).alias("is_positive"))

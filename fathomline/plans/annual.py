"""Yearly theme rankings and weekly early-rise signals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import AnnualConfig
from fathomline.functions.expr import before_now, choose, gate
from fathomline.operators.metrics import theme_metrics
from fathomline.operators.panel import Panel

#: Texts of the result's rows.
DISCLAIMER = "무료 공개 데이터 기반 연구·관찰용 결과이며 투자 권고나 매수 신호가 아닙니다."
RECOMMENDATION = "관찰 전용 · 매수 추천 아님"
TOO_LITTLE, CONFIRMED, WATCHED, UNMET = "자료 부족", "초입 확인", "초입 관찰", "조건 미충족"


def until(data: DataFrame, as_of: date | str | None) -> DataFrame:
    """Rows up to midnight of as_of. Decision dates aren't trimmed: a mid-week as_of leaves the week that ends on the next Friday."""
    return data if as_of is None else data.where(F.col("date").cast("timestamp_ntz") <= F.lit(str(as_of)).cast("timestamp_ntz"))


def _edges(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """For each year: the first and last week with a value, both values, how many there are; and the last of earlier years."""
    there = F.col(value).isNotNull()
    own = rows.groupBy(*by, "year").agg(
        F.min_by(F.struct("week", value), F.when(there, F.col("week"))).alias("first"),
        F.max_by(F.struct("week", value), F.when(there, F.col("week"))).alias("last"),
    )
    earlier = Window.partitionBy(*(by or (F.lit(0),))).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("last", ignorenulls=True).over(earlier)
    return own.withColumn("before", before).select(
        *by,
        "year",
        F.coalesce(F.col("before.week"), F.col("first.week")).alias("start_date"),
        F.coalesce(F.col(f"before.{value}"), F.col(f"first.{value}")).alias("start"),
        F.col("last.week").alias("end_date"),
        F.col(f"last.{value}").alias("end"),
        F.col("before").isNull().alias("partial"),
    )


def annual_theme_leaders(data: DataFrame, config: AnnualConfig | None = None, as_of: date | str | None = None, panel: Panel | None = None) -> DataFrame:
    """The top_n themes of each calendar year (of the week's Friday) by return from the last index value of earlier years, or the first of the year, to the last of the year.

    panel: that of data until as_of, if it is there already. Only rows of status ok are ranked and returned; ties share the smaller rank. Years have one row for each theme, so the joins with yearly benchmark and calendar rows are small.
    """
    c = config or AnnualConfig()
    panel = panel or Panel(until(data, as_of), c.panel)
    themes = panel.themes.withColumn("year", F.year("week"))
    calendar = panel.benchmark.withColumn("year", F.year("week"))
    per_year = calendar.groupBy("year").agg(F.count("*").alias("weeks"), F.max("week").alias("last_week"), F.count("b_price").alias("b_weeks"))
    bench = _edges(calendar, "b_price").select("year", "partial", F.when(F.col("start") > 0, F.col("end") / F.col("start") - 1.0).alias("benchmark_return")).withColumnRenamed("partial", "b_partial")
    observed = themes.groupBy("theme", "year").agg(F.count("theme_return").alias("observations"))
    rows = _edges(themes, "theme_index", "theme").join(observed, ["theme", "year"]).join(F.broadcast(per_year), "year").join(F.broadcast(bench), "year")
    rows = rows.withColumns(
        {
            "theme_return": F.when(F.col("start") > 0, F.col("end") / F.col("start") - 1.0),
            "_coverage": F.col("observations") / F.col("weeks"),
            "_b_coverage": F.col("b_weeks") / F.col("weeks"),
            "_ytd": F.col("last_week") < F.make_date("year", F.lit(12), F.lit(15)),
        }
    )
    status = choose(
        (F.col("benchmark_return").isNull() | (F.col("_b_coverage") < c.min_coverage), "benchmark_unavailable"),
        (F.col("theme_return").isNull(), "insufficient_history"),
        ((F.col("observations") < c.min_weeks_per_year) | (F.col("_coverage") < c.min_coverage), "insufficient_coverage"),
        otherwise="ok",
    )
    rows = rows.withColumn("status", status).where("status = 'ok'")
    rows = rows.withColumn("rank", F.rank().over(Window.partitionBy("year").orderBy(F.col("theme_return").desc()))).where(F.col("rank") <= c.top_n)
    year = F.col("year").cast("string")
    return rows.select(
        "year",
        F.when(F.col("_ytd"), F.concat(year, F.lit("년 누적"))).otherwise(F.concat(year, F.lit("년"))).alias("period_label"),
        "theme",
        "theme_return",
        "benchmark_return",
        (F.col("theme_return") - F.col("benchmark_return")).alias("excess_return"),
        "rank",
        F.round("_coverage", 4).alias("coverage"),
        F.round("_b_coverage", 4).alias("benchmark_coverage"),
        "observations",
        F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date"),
        (F.col("_ytd") | F.col("partial") | F.col("b_partial")).alias("is_partial_year"),
        "status",
        F.lit(DISCLAIMER).alias("disclaimer"),
    )


def early_rise_signals(data: DataFrame, config: AnnualConfig | None = None, as_of: date | str | None = None, panel: Panel | None = None) -> DataFrame:
    """One row for each theme and week: watched when eight gates hold, confirmed on the week when enough of the last weeks were watched and the week before wasn't so."""
    c = config or AnnualConfig()
    rows = theme_metrics(panel or Panel(until(data, as_of), c.panel)).withColumn("rank_improvement_4v13", F.col("rs_rank_4w") - F.col("rs_rank_13w"))
    least = {
        "history_weeks": c.signal_history_weeks,
        "rs_4w": c.early_min_fast_rs,
        "m0": c.early_min_m0,
        "rs_rank_4w": c.early_min_rank,
        "early_acceleration_rank": c.early_min_acceleration_rank,
        "rank_improvement_4v13": c.early_min_rank_improvement,
        "breadth_4w": c.early_min_breadth,
        "participation": c.early_min_participation,
    }
    rows = rows.withColumn("early_watch", gate(*(F.col(n) >= F.lit(float(v)) for n, v in least.items())))
    by = Window.partitionBy("theme").orderBy("week")
    over = before_now(by, c.confirmation_window_weeks)
    rows = rows.withColumn("confirmation_count", F.when(F.count(F.lit(1)).over(over) == c.confirmation_window_weeks, F.sum(F.col("early_watch").cast("double")).over(over)))
    rows = rows.withColumn("_state", gate(F.col("confirmation_count") >= c.confirmation_count))
    rows = rows.withColumn("early_confirmed", F.col("_state") & ~F.coalesce(F.lag("_state").over(by), F.lit(False)))
    status = choose(
        (F.coalesce(F.col("history_weeks") < c.signal_history_weeks, F.lit(True)), TOO_LITTLE), (F.col("early_confirmed"), CONFIRMED), (F.col("early_watch"), WATCHED), otherwise=UNMET
    )
    return rows.withColumn("status", status).select(
        F.col("week").alias("decision_date"),
        "theme",
        "early_watch",
        "early_confirmed",
        F.col("status").alias("signal_type"),
        "rs_4w",
        "rs_13w",
        F.col("m0").alias("m0_26w_spy_relative"),
        "rs_rank_4w",
        F.col("early_acceleration_rank").alias("acceleration_rank"),
        "rank_improvement_4v13",
        "breadth_4w",
        "participation",
        "history_weeks",
        "confirmation_count",
        "status",
        F.lit(RECOMMENDATION).alias("recommendation"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )


def latest_by_theme(rows: DataFrame, at: str = "decision_date") -> DataFrame:
    """The last row of each theme."""
    return rows.groupBy("theme").agg(F.max_by(F.struct(*rows.columns), at).alias("_row")).select("_row.*")


def annual_leadership_report(data: DataFrame, config: AnnualConfig | None = None, as_of: date | str | None = None) -> dict[str, DataFrame]:
    """Both tables, the latest row of each theme, and the latest rows that are watched or confirmed."""
    c = config or AnnualConfig()
    panel = Panel(until(data, as_of), c.panel)
    early = early_rise_signals(data, c, as_of, panel)
    latest = latest_by_theme(early)
    return {"annual_leaders": annual_theme_leaders(data, c, as_of, panel), "early_signals": early, "latest": latest, "latest_early": latest.where("early_watch or early_confirmed")}

"""Scorecards: a transparent one for any entity's observations, and one over the latest rows of the three lanes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import Clock
from fathomline.functions.expr import clipped
from fathomline.plans.annual import latest_by_theme

#: Weights, bucket names, the text of each row.
WEIGHTS = {"momentum": 0.40, "breadth": 0.25, "quality": 0.20, "risk_control": 0.15}
BUCKETS = ("Current Leader", "Emerging Radar", "12M Hold Candidate")
DISCLAIMER = "Research candidate, not investment recommendation."


def _level(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "High").when(confidence >= 0.55, "Medium").otherwise("Low")


def _flags(*pairs: tuple[Column, str]) -> Column:
    named = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs)), lambda x: x.isNotNull())
    return F.when(F.size(named) == 0, F.array(F.lit("none flagged"))).otherwise(named)


def scorecard(records: DataFrame, clock: Clock | None = None) -> DataFrame:
    """records: (entity, date, value). One row for each entity: growth, deviation of returns (population), components, score, bucket, confidence, flags."""
    rows = records.select(F.coalesce(F.trim("entity"), F.lit("Unknown")).alias("entity"), F.to_date("date").alias("date"), F.col("value").cast("double").alias("value"))
    dates = rows.groupBy("entity").agg(F.max("date").alias("as_of"))
    by = Window.partitionBy("entity").orderBy("date", "value")
    steps = rows.where("value is not null").withColumn("_before", F.lag("value").over(by)).withColumn("_n", F.row_number().over(by))
    each = steps.groupBy("entity").agg(
        F.count("*").alias("observations"),
        F.min_by("value", "_n").alias("_first"),
        F.max_by("value", "_n").alias("_last"),
        F.count(F.when(F.col("_before") != 0, 1)).alias("_returns"),
        F.stddev_pop(F.when(F.col("_before") != 0, F.try_divide("value", "_before") - 1.0)).alias("_dev"),
    )
    rows = dates.join(each, "entity", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    n = F.col("observations")
    growth = F.when((n >= 2) & (F.col("_first") != 0), F.try_divide("_last", "_first") - 1.0).otherwise(0.0)
    rows = rows.withColumns({"_growth": growth, "_vol": F.when(F.col("_returns") >= 2, F.col("_dev")).otherwise(0.0)})
    rows = rows.withColumns(
        {
            "momentum": clipped(50.0 + F.col("_growth") * 150.0, 0.0, 100.0),
            "breadth": clipped(25.0 + n / 12.0 * 75.0, 0.0, 100.0),
            "quality": clipped(35.0 + F.least(F.lit(1.0), n / 20.0) * 65.0, 0.0, 100.0),
            "risk_control": clipped(100.0 - F.col("_vol") * 500.0, 0.0, 100.0),
        }
    )
    score = reduce(lambda a, b: a + b, (w * F.col(k) for k, w in WEIGHTS.items()))
    confidence = clipped(0.55 * F.least(F.lit(1.0), n / 20.0) + F.when(F.col("as_of").isNotNull(), 0.25).otherwise(0.0) + F.when(n >= 2, 0.20).otherwise(0.0), 0.0, 1.0)
    age = F.greatest(F.datediff(F.lit(clock.today) if clock else F.current_date(), "as_of"), F.lit(0))
    rows = rows.withColumns({"_score": score, "_confidence": confidence, "freshness_days": F.when(F.col("as_of").isNotNull(), age)})
    flags = _flags((n < 5, "sparse history"), (F.col("as_of").isNull(), "missing as-of date"), (F.col("_vol") > 0.08, "high volatility"), (F.col("freshness_days") > 45, "stale data"))
    return rows.select(
        "entity",
        F.round("_score", 2).alias("score"),
        F.when(F.col("_score") >= 70, BUCKETS[0]).when(F.col("_score") >= 50, BUCKETS[1]).otherwise(BUCKETS[2]).alias("bucket"),
        *(F.round(k, 2).alias(k) for k in WEIGHTS),
        F.round(F.col("_confidence") * 100.0, 1).alias("data_confidence"),
        F.round("_confidence", 3).alias("confidence"),
        _level(F.col("_confidence")).alias("confidence_label"),
        F.array_join(flags, "; ").alias("risk_flags"),
        "as_of",
        "freshness_days",
        "observations",
        F.lit(DISCLAIMER).alias("disclaimer"),
    )


def _component(*names: Column, default: Column) -> Column:
    value = F.coalesce(*names, default)
    return clipped(F.when(F.abs(value) <= 1.5, value * 100.0).otherwise(value), 0.0, 100.0)


def lane_scorecard(leader: DataFrame, radar: DataFrame, hold: DataFrame, clock: Clock | None = None) -> DataFrame:
    """The latest row of each lane and theme as 0 to 100 components. A theme may stand in several lanes."""
    lanes = []
    for bucket, engine, rows, score in zip(BUCKETS, ("current_leader", "emerging_radar", "hold_candidate_12m"), (leader, radar, hold), ("leader_score", "radar_score", "candidate_score"), strict=True):
        have = lambda n, rows=rows: F.col(n) if n in rows.columns else F.lit(None).cast("double")
        lanes.append(
            latest_by_theme(rows).select(
                F.lit(bucket).alias("bucket"),
                F.lit(engine).alias("engine"),
                F.col("theme").alias("entity"),
                "status",
                "warnings",
                F.col("decision_date").alias("as_of"),
                F.coalesce("history_weeks", F.lit(0.0)).alias("_history"),
                _component(F.col(score), default=F.lit(0.0)).alias("score"),
                _component(have("rs_rank_13w"), have("rs_rank_4w"), have("acceleration_rank"), have("candidate_score"), default=_component(F.col(score), default=F.lit(0.0))).alias("momentum"),
                _component(have("breadth_average"), have("breadth_4w"), have("breadth_13w"), default=F.lit(50.0)).alias("breadth"),
                have("annualized_volatility_26w").alias("_vol"),
            )
        )
    rows = reduce(DataFrame.unionByName, lanes)
    age = F.greatest(F.datediff(F.lit(clock.today) if clock else F.current_date(), "as_of"), F.lit(0))
    status_flag = F.col("status").isin("insufficient_history", "warning", "risk_rejected", "awaiting_confirmation")
    named = F.filter(F.split("warnings", "; "), lambda x: x != "")
    base = F.when(F.size(named) > 0, named).when(status_flag, F.array("status")).otherwise(F.array(F.lit("none flagged")))
    rows = rows.withColumns({"freshness_days": age, "_base": base})
    flags = F.array_distinct(F.concat("_base", F.when(F.col("freshness_days") > 45, F.array(F.lit("stale data"))).otherwise(F.array().cast("array<string>"))))
    rows = rows.withColumn("_flags", flags)
    confidence = clipped(F.least(F.lit(1.0), F.col("_history") / 52.0) * F.when(F.array_join("_flags", ";") != "none flagged", 0.85).otherwise(1.0), 0.0, 1.0)
    return rows.select(
        "entity",
        F.round("score", 2).alias("score"),
        "bucket",
        "engine",
        "status",
        F.round("momentum", 2).alias("momentum"),
        F.round("breadth", 2).alias("breadth"),
        F.round(clipped(F.col("_history") / 52.0 * 100.0, 0.0, 100.0), 2).alias("quality"),
        F.round(F.coalesce(clipped(100.0 - F.col("_vol") * 100.0, 0.0, 100.0), F.lit(75.0)), 2).alias("risk_control"),
        F.round(confidence * 100.0, 1).alias("data_confidence"),
        F.round(confidence, 3).alias("confidence"),
        _level(confidence).alias("confidence_label"),
        F.array_join("_flags", "; ").alias("risk_flags"),
        "as_of",
        "freshness_days",
        F.when(F.col("_history") > 0, F.col("_history").cast("bigint")).alias("observations"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )


def validation_counts(records: DataFrame) -> DataFrame:
    """rows, entities, dated rows, duplicates by entity and date, unreadable dates of (entity, date as text, value)."""
    from fathomline.functions.parsing import safe_date, safe_number

    rows = records.select("entity", safe_date(F.col("date")).alias("_at"), F.col("date").isNotNull().alias("_given"), safe_number(F.col("value")).alias("_value"))
    groups = rows.groupBy("entity", "_at").agg(F.count("*").alias("_n"), F.count("_value").alias("_values"), F.count_if(F.col("_given") & F.col("_at").isNull()).alias("_bad"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_distinct("entity").alias("entities"),
        F.coalesce(F.sum(F.when(F.col("_at").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("unparseable_dates"),
        F.coalesce(F.sum("_values"), F.lit(0)).alias("numeric_values"),
    )

"""Scorecards for presentation: pre-scored files, price files that are scored here, and a demo where nothing can be read."""

from __future__ import annotations

from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.config import Clock
from fathomline.functions.parsing import canonical, safe_date, safe_number
from fathomline.operators import scorecard
from fathomline.plans import pipeline
from fathomline.sources.readers import normalised_records, read_rows, tidy_panel

#: The demo's entities, scores, buckets, components, confidence and flags.
DEMO = [
    ("AI Infrastructure", 86.4, 0, 88.0, 84.0, 91.0, 79.0, 0.88, "none flagged"),
    ("Cybersecurity", 66.8, 1, 73.0, 65.0, 70.0, 53.0, 0.71, "valuation sensitivity"),
    ("Grid Modernization", 44.7, 2, 43.0, 56.0, 63.0, 18.0, 0.58, "high volatility; sparse history"),
]
#: What the demo's rows say of themselves, the engines of the buckets, and how old and long its series are.
ENGINES, OTHER_ENGINE = ("current_leader", "emerging_radar", "hold_candidate_12m"), "local_scorecard"
DEMO_DAYS, DEMO_OBSERVATIONS = 2, 24
FIELDS = [
    "entity", "score", "signal_score", "bucket", "engine", *scorecard.WEIGHTS, "data_confidence", "confidence", "confidence_label", "risk_flags", "as_of", "freshness_days", "observations", "disclaimer",
]


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "High").when(confidence >= 0.55, "Medium").otherwise("Low")


def demo_scorecard(spark: SparkSession, clock: Clock | None = None) -> DataFrame:
    names = ["entity", "score", "_bucket", *scorecard.WEIGHTS, "confidence", "risk_flags"]
    kinds = ["string", "double", "int", *["double"] * len(scorecard.WEIGHTS), "double", "string"]
    rows = spark.createDataFrame(DEMO, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), F.col("_bucket") + 1)
    day = (clock.today if clock else date.today()) - timedelta(days=DEMO_DAYS)
    rows = rows.withColumns({"signal_score": F.col("score"), "bucket": pick(scorecard.BUCKETS), "engine": pick(ENGINES), "data_confidence": F.round(F.col("confidence") * 100.0, 1), "confidence_label": level(F.col("confidence"))})
    rows = rows.withColumns({"as_of": F.lit(day), "freshness_days": F.lit(DEMO_DAYS), "observations": F.lit(DEMO_OBSERVATIONS).cast("bigint"), "disclaimer": F.lit(scorecard.DISCLAIMER)})
    return rows.select(FIELDS)


def filled(rows: DataFrame) -> DataFrame:
    """FIELDS of rows that have a score, with defaults for what an older export lacks: bucket and components from the score, confidence and data_confidence from each other."""
    have = {canonical(c): F.col(f"`{c}`") for c in reversed(rows.columns)}
    text = lambda *names: F.coalesce(*(F.nullif(F.trim(have[canonical(n)].cast("string")), F.lit("")) for n in names if canonical(n) in have), F.lit(None).cast("string"))
    number = lambda name: safe_number(text(name))
    score = F.coalesce(number("score"), F.lit(0.0))
    bucket = F.coalesce(text("bucket"), F.when(score >= 70, scorecard.BUCKETS[0]).when(score >= 50, scorecard.BUCKETS[1]).otherwise(scorecard.BUCKETS[2]))
    engine = F.lit(OTHER_ENGINE)
    for name, own in zip(scorecard.BUCKETS, ENGINES, strict=True):
        engine = F.when(bucket == name, own).otherwise(engine)
    data = F.coalesce(number("data_confidence"), F.coalesce(number("confidence"), F.lit(0.5)) * 100.0)
    sure = F.coalesce(number("confidence"), data / 100.0)
    when = safe_date(text("as_of", "date", "asof")).cast("date")
    out = {
        "entity": F.coalesce(text("entity", "theme", "symbol", "ticker"), F.lit("Unknown")),
        "score": score,
        "signal_score": F.coalesce(number("signal_score"), score),
        "bucket": bucket,
        "engine": F.coalesce(text("engine"), engine),
        **{k: F.coalesce(number(k), F.round(score, 2)) for k in scorecard.WEIGHTS},
        "data_confidence": data,
        "confidence": sure,
        "confidence_label": F.coalesce(text("confidence_label"), level(sure)),
        "risk_flags": F.coalesce(text("risk_flags"), F.lit("none flagged")),
        "as_of": when,
        "freshness_days": number("freshness_days").cast("int"),
        "observations": number("observations").cast("bigint"),
        "disclaimer": F.coalesce(text("disclaimer"), F.lit(scorecard.DISCLAIMER)),
    }
    return rows.select(*(v.alias(k) for k, v in out.items()))


def _as_presented(rows: DataFrame, engine: str | None) -> DataFrame:
    extra = {"signal_score": F.col("score")} | ({"engine": F.lit(engine)} if engine else {})
    return rows.withColumns(extra).select(FIELDS)


def load_scorecard(spark: SparkSession, path: str | None = None, clock: Clock | None = None) -> tuple[DataFrame, str]:
    """(rows of FIELDS, where they are from). A file whose rows have a score is filled with defaults; one with dates, themes, securities and values goes through the three lanes; any other through the generic scorecard;
    without a path, and where a file can't be read or holds nothing, the demo."""
    if path is None:
        return demo_scorecard(spark, clock), "demo"
    try:
        rows = read_rows(spark, path)
        if rows.isEmpty():
            return demo_scorecard(spark, clock), path
        if "score" in {c.strip().lower() for c in rows.columns}:
            return filled(rows), path
        tidy = tidy_panel(rows)
        if tidy is not None and not tidy.isEmpty():
            run = pipeline.run_signal_pipeline(tidy)
            scored = scorecard.lane_scorecard(run.current_leader, run.emerging_radar, run.hold_candidate, clock)
            if not scored.isEmpty():
                return _as_presented(scored, None), path
        scored = scorecard.scorecard(normalised_records(rows), clock)
        return (demo_scorecard(spark, clock) if scored.isEmpty() else _as_presented(scored, OTHER_ENGINE)), path
    except (OSError, ValueError, PySparkException, Py4JJavaError):
        return demo_scorecard(spark, clock), f"demo (can't read {path})"

"""Windows held out for judging models: historical surges and negative controls. Nothing is tuned on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, theme, first and last day, kind and description of the surges.
SURGES = [
    ("solar_2013", "solar", "2013-01-01", "2013-12-31", "historical_surge", "solar-theme historical surge challenge window"),
    ("solar_2020", "solar", "2020-01-01", "2020-12-31", "historical_surge", "solar-theme pandemic-era surge challenge window"),
    ("quantum_2024", "quantum", "2024-01-01", "2024-12-31", "historical_surge", "quantum-theme 2024 challenge window"),
    ("evtol_2023", "evtol", "2023-01-01", "2023-12-31", "historical_surge", "eVTOL-theme 2023 challenge window"),
    ("evtol_2024", "evtol", "2024-01-01", "2024-12-31", "concentration_stress", "eVTOL-theme 2024 concentration stress window"),
]
#: Themes and descriptions of the negative controls, the days between which all of them lie, and where all cases are from.
CONTROLS = [
    ("3d_printing", "3D-printing boom/bust control"),
    ("cannabis", "cannabis boom/bust control"),
    ("metaverse", "metaverse failed-leadership control"),
    ("hydrogen", "hydrogen boom/bust control"),
    ("space", "space failed-leadership control"),
    ("ev_battery", "EV and battery failed-leadership control"),
    ("clean_energy", "clean-energy failed-leadership control"),
    ("china_internet", "China internet failed-leadership control"),
    ("spac", "SPAC pre-business-combination eligibility control"),
]
CONTROL_DAYS = ("2018-01-01", "2025-12-31")
SOURCE = "research_challenge_manifest"
SCHEMA = "name string, theme string, start date, end date, expected_positive boolean, case_type string, description string, used_for_tuning boolean, source string, is_negative_control boolean"


def challenge_cases(spark: SparkSession, include_negative_controls: bool = True) -> DataFrame:
    rows = [(name, theme, start, end, True, kind, about, False, SOURCE, False) for name, theme, start, end, kind, about in SURGES]
    if include_negative_controls:
        rows += [(name, name, *CONTROL_DAYS, False, "negative_control", about, False, SOURCE, True) for name, about in CONTROLS]
    raw = spark.createDataFrame(rows, SCHEMA.replace("date", "string"))
    return raw.withColumns({n: F.to_date(n) for n in ("start", "end")})


def challenge_case(spark: SparkSession, name: str) -> dict:
    found = challenge_cases(spark).where(F.col("name") == name).collect()
    if not found:
        raise KeyError(f"unknown challenge case: {name}")
    return found[0].asDict()


def validate_challenges(cases: DataFrame) -> None:
    """Names are unique, nothing is used for tuning, and no window ends before it starts."""
    bad = cases.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("used_for_tuning").alias("tuned"), F.bool_or(F.col("start") > F.col("end")).alias("turned")).where("n > 1 or tuned or turned").head(1)
    if bad:
        raise ValueError(f"challenge case {bad[0]['name']} repeats, is used for tuning, or ends before it starts")

"""Checks of feature tables: availability, membership dates, fund histories, coverage, duplicate keys.

Each check gives at most a few issue rows (code, count, examples); several checks over one table are conditional sums in a single pass. Missing metadata columns skip an optional check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.expr import number

EXAMPLES = 5


class IntegrityError(ValueError):
    """The audit found issues."""


def _first(df: DataFrame, *names: str) -> Column | None:
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else None


def _time(column: Column) -> Column:
    return column.cast("timestamp")


def _key(df: DataFrame) -> Column:
    names = [n for n in ("decision_at", "symbol") if n in df.columns]
    return F.concat_ws("|", *(F.col(n).cast("string") for n in names)) if names else F.lit("row")


def issues(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """code, count, examples (the first EXAMPLES keys in order) of each check that some rows fail. Examples are kept as bounded minima, not as a list of all failures."""
    key = _key(df)
    if not checks:
        return df.sparkSession.createDataFrame([], "code string, count bigint, examples array<string>")
    failed = [F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in checks.items()]
    rows = df.select(key.alias("_key"), F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("code"))
    counts = rows.groupBy("code").agg(F.count("*").alias("count"))
    from pyspark.sql import Window

    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("_key"))).where(F.col("_n") <= EXAMPLES)
    examples = some.groupBy("code").agg(F.array_sort(F.collect_list("_key")).alias("examples"))
    return counts.join(examples, "code").select("code", "count", "examples")


def availability_checks(df: DataFrame) -> dict[str, Column]:
    if "feature_available_at" not in df.columns:
        return {"missing_feature_available_at": F.lit(True)}
    decision, available = _time(F.col("decision_at")), _time(F.col("feature_available_at"))
    return {"invalid_feature_timestamp": decision.isNull() | available.isNull(), "feature_after_decision": available > decision}


def membership_checks(df: DataFrame) -> dict[str, Column]:
    """End dates are inclusive here."""
    start = _first(df, "membership_start", "member_since", "inception_date")
    if start is None:
        return {}
    end = _first(df, "membership_end", "member_until", "delisted_at")
    decision = _time(F.col("decision_at"))
    late = decision > _time(end) if end is not None else F.lit(False)
    return {"missing_membership_date": start.isNull(), "membership_out_of_range": start.isNotNull() & (decision.isNull() | (decision < _time(start)) | F.coalesce(late, F.lit(False)))}


def inception_checks(df: DataFrame) -> dict[str, Column]:
    start = _first(df, "etf_inception", "inception_date", "fund_inception")
    if start is None:
        return {}
    return {"missing_etf_inception": start.isNull(), "before_etf_inception": _time(F.col("decision_at")) < _time(start)}


def history_checks(df: DataFrame, min_history_weeks: int = 26) -> dict[str, Column]:
    """A history column comes first, for rows whose asset type is etf (all rows, where there is no such column); else weeks since inception."""
    if "history_weeks" in df.columns:
        kind = next((F.lower(F.col(n)) == "etf" for n in ("asset_type", "instrument_type", "security_type") if n in df.columns), F.lit(True))
        weeks = number(F.col("history_weeks"))
        return {"insufficient_etf_history": kind & (weeks.isNull() | (weeks < min_history_weeks))}
    start = _first(df, "etf_inception", "inception_date", "fund_inception")
    if start is None:
        return {}
    return {"insufficient_etf_history": _time(F.col("decision_at")) < _time(start) + F.make_dt_interval(F.lit(7 * min_history_weeks))}


def coverage_checks(df: DataFrame, min_coverage: float = 0.95) -> dict[str, Column]:
    if not 0 <= min_coverage <= 1:
        raise ValueError("min_coverage must lie in [0, 1]")
    if "coverage" in df.columns:
        share = number(F.col("coverage"))
    elif {"coverage_count", "expected_count"} <= set(df.columns):
        share = F.try_divide(number(F.col("coverage_count")), F.nullif(number(F.col("expected_count")), F.lit(0.0)))
    else:
        return {"missing_coverage": F.lit(True)}
    return {"insufficient_coverage": share.isNull() | (share < min_coverage)}


def audit_duplicates(df: DataFrame, keys: tuple[str, ...] = ("decision_at", "symbol")) -> DataFrame:
    """The issue of rows that share the keys that there are; a key with very many rows is one row after the partial sums."""
    have = [k for k in keys if k in df.columns]
    if not have:
        return issues(df, {})
    repeated = df.groupBy(*have).agg(F.count("*").alias("_n")).where("_n > 1")
    total = repeated.agg(F.sum("_n").alias("count")).where("count is not null")
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in have))
    some = repeated.select(text.alias("k")).orderBy("k").limit(EXAMPLES).agg(F.array_sort(F.collect_list("k")).alias("examples"))
    return total.join(F.broadcast(some), F.lit(True)).select(F.lit("duplicate_feature_key").alias("code"), "count", "examples")


def joined_metadata(df: DataFrame, metadata: DataFrame | None, names: dict[str, str]) -> DataFrame:
    """Columns of metadata (symbol, ...) looked up by symbol; a value of df itself fills in where the look-up has none."""
    if metadata is None:
        return df
    own = metadata.select(F.col("symbol"), *(F.col(a).alias(f"_m_{b}") for a, b in names.items()))
    rows = df.join(own, "symbol", "left")
    for b in names.values():
        rows = rows.withColumn(b, F.coalesce(F.col(f"_m_{b}"), F.col(b)) if b in df.columns else F.col(f"_m_{b}"))
    return rows.drop(*(f"_m_{b}" for b in names.values()))


def audit_integrity(df: DataFrame, min_coverage: float = 0.95, min_history_weeks: int = 26, memberships: DataFrame | None = None, inceptions: DataFrame | None = None) -> DataFrame:
    """All checks. memberships: (symbol, start, end), inceptions: (symbol, inception)."""
    rows = joined_metadata(df, memberships, {"start": "membership_start", "end": "membership_end"})
    rows = joined_metadata(rows, inceptions, {"inception": "etf_inception"})
    checks = reduce(lambda a, b: a | b, [availability_checks(rows), membership_checks(rows), inception_checks(rows), history_checks(rows, min_history_weeks), coverage_checks(rows, min_coverage)])
    return issues(rows, checks).unionByName(audit_duplicates(df))


def assert_integrity(df: DataFrame, **options) -> None:
    found = audit_integrity(df, **options).collect()  # a row for each kind of issue
    if found:
        raise IntegrityError("; ".join(f"{r['code']}: {r['count']}" for r in sorted(found)))

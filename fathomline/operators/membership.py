"""Bitemporal memberships: valid from (inclusive) to (exclusive), and when the evidence was known."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class LookaheadError(ValueError):
    """A row rests on evidence that wasn't known yet."""


class MembershipConflictError(ValueError):
    """Two intervals of one member overlap."""


def memberships_as_of(memberships: DataFrame, as_of: date | str, theme_id: str | None = None, tiers: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Members of a day: valid_from <= day < valid_to (null: open) with evidence known by the end of the day. strict raises on any valid member with later evidence."""
    day = F.to_date(F.lit(str(as_of)))
    rows = memberships
    if theme_id is not None:
        rows = rows.where(F.col("theme_id") == theme_id)
    if tiers:
        rows = rows.where(F.lower("exposure_tier").isin(*[t.lower() for t in tiers]))
    if strict:
        assert_no_lookahead(rows, as_of)
    valid = (F.to_date("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.to_date("valid_to")))
    return rows.where(valid & (F.to_date("evidence_available_at") <= day))


def assert_no_lookahead(memberships: DataFrame, as_of: date | str) -> None:
    late = memberships.where(F.to_date("evidence_available_at") > F.to_date(F.lit(str(as_of)))).select("theme_id", "permanent_id").head(1)
    if late:
        raise LookaheadError(f"evidence of {late[0]['theme_id']}/{late[0]['permanent_id']} is later than {as_of}")


def overlaps(memberships: DataFrame) -> DataFrame:
    """Rows that begin before the row before them, of the same theme and member, has ended."""
    by = Window.partitionBy("theme_id", "permanent_id").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    rows = memberships.withColumns({"previous_from": F.lag("valid_from").over(by), "previous_to": F.lag("valid_to").over(by)})
    return rows.where(F.col("previous_from").isNotNull() & (F.col("previous_to").isNull() | (F.col("valid_from") < F.col("previous_to"))))


def validate_memberships(memberships: DataFrame) -> None:
    bad = overlaps(memberships).select("theme_id", "permanent_id", "previous_from", "valid_from").head(1)
    if bad:
        raise MembershipConflictError(f"overlapping intervals for {bad[0]['theme_id']}/{bad[0]['permanent_id']}: {bad[0]['previous_from']} and {bad[0]['valid_from']}")


def unknown_themes(memberships: DataFrame, themes: DataFrame) -> DataFrame:
    """Members of themes that the catalog doesn't have."""
    return memberships.join(themes.select("theme_id"), "theme_id", "left_anti")


def theme_counts(themes: DataFrame, memberships: DataFrame) -> DataFrame:
    counts = memberships.groupBy("theme_id").agg(F.count("*").alias("members"))
    return themes.join(counts, "theme_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))

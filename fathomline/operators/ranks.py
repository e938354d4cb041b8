"""Ranks within wide groups, in two levels, so that no task holds a group.

Equal values of a group are counted first, before the shuffle where they can be. The counts are cut by range into slices of neighbouring (group, value); a slice's total goes into a small table, in which sums over the slices before give where a slice begins, and a
window over slice and group gives the place in it. A group of any width spreads over as many tasks as it has slices, and ranks come back to their rows by a join on group and value. Slices come from a sample, so their table is written once; which slices there are changes no rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.sources.shared import written


def slices_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def places(rows: DataFrame, value: Column, by: Sequence[str], slices: int | None = None) -> DataFrame:
    """For each group (columns _by0, ...; null is a group) and value that isn't null (_value): _before, how many rows have smaller ones, _same, how many have it, _of, how many have any. value is of any type that can be ordered, structs included."""
    keys = [f"_by{i}" for i in range(len(by))]
    counts = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), value.alias("_value")).where("_value is not null").groupBy(*keys, "_value").agg(F.count("*").alias("_same"))
    counts = written(counts.repartitionByRange(slices or slices_of(rows), *keys, "_value").withColumn("_slice", F.spark_partition_id()), "rank-counts")
    totals = counts.groupBy(*keys, "_slice").agg(F.sum("_same").alias("_sum"))
    group = Window.partitionBy(*keys)
    starts = totals.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_slice").alias("_slice_"), (F.sum("_sum").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")).alias("_start"), F.sum("_sum").over(group).alias("_of"))
    own = Window.partitionBy(*keys, "_slice").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_before", F.sum("_same").over(own) - F.col("_same"))
    same = F.col("_slice") == F.col("_slice_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return placed.join(starts, same).select(*keys, "_value", (F.col("_before") + F.col("_start")).alias("_before"), "_same", "_of")


def with_places(rows: DataFrame, value: Column, by: Sequence[str], made: Sequence[tuple[str, Column]], slices: int | None = None) -> DataFrame:
    """rows with further columns (name, expression over _before, _same and _of); null for rows without a value. Repeated rows stay."""
    table = places(rows, value, by, slices)
    match = F.col("_own") == F.col("_value")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.withColumn("_own", value).join(table, match, "left").select(*(F.col(f"`{c}`") for c in rows.columns), *(e.alias(n) for n, e in made))


def with_average_rank(rows: DataFrame, value: str, by: Sequence[str], out: str, share: bool = False, slices: int | None = None) -> DataFrame:
    """rows with the average-tie rank of value within the group, from 1, as `out`; share: divided by how many values the group has. Nulls have none. With share the same numbers as functions.expr.percentile_rank, whose window holds a group in one task."""
    rank = F.col("_before") + F.lit(1) + (F.col("_same") - F.lit(1)) / F.lit(2.0)
    return with_places(rows, F.col(value), by, [(out, rank / F.col("_of") if share else rank)], slices)

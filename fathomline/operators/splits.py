"""Purged, embargoed walk-forward splits of a date dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import SplitConfig


def purged_walk_forward_splits(dates: DataFrame, config: SplitConfig | None = None) -> DataFrame:
    """dates: one row for each date with, optionally, label_end. Returns (split_id, role, pos, date), role train or test; features join it on date.

    Test folds are the last n_splits * test_size dates. A training date lies before its fold, was not embargoed after the fold before, has a label known before the fold starts (where there are
    label ends; null ones go), and lies before the date `embargo` places ahead of the fold. Folds with too few training dates are left out. The table has a row for each date, so it is small.
    """
    c = config or SplitConfig()
    order = Window.orderBy("date")
    has_end = "label_end" in dates.columns
    rows = dates.select("date", *(["label_end"] if has_end else [])).dropDuplicates(["date"]).withColumn("pos", F.row_number().over(order) - 1)
    n = rows.count()
    if n == 0:
        return rows.select(F.lit(0).alias("split_id"), F.lit("train").alias("role"), "pos", "date").limit(0)
    test_size = c.test_size or max(1, n // (c.n_splits + 1))
    first = n - c.n_splits * test_size
    if first < c.min_train_size:
        raise ValueError("not enough observations for the requested splits and min_train_size")
    at = {r["pos"]: r["date"] for r in rows.where(F.col("pos").isin(*[p for k in range(c.n_splits) for s in [first + k * test_size] for p in (s, s + test_size - 1, max(0, s - c.embargo))])).collect()}
    splits = []
    previous_end = None
    for k in range(c.n_splits):
        start = first + k * test_size
        keep = F.col("pos") < start
        if c.train_size is not None:
            keep = keep & (F.col("pos") >= start - c.train_size)
        if previous_end is not None and c.embargo:
            keep = keep & ((F.col("pos") <= previous_end) | (F.col("pos") > previous_end + c.embargo))
        if has_end:
            keep = keep & F.coalesce(F.col("label_end") < F.lit(at[start]), F.lit(False))
        if c.embargo:
            keep = keep & (F.col("date") < F.lit(at[max(0, start - c.embargo)]))
        test = F.col("pos").between(start, start + test_size - 1)
        role = F.when(test, "test").when(keep, "train")
        splits.append((k, role))
        previous_end = start + test_size - 1
    each = F.array(*(F.struct(F.lit(k).alias("split_id"), role.alias("role")) for k, role in splits))
    long = rows.select("pos", "date", F.explode(each).alias("_s")).select(F.col("_s.split_id"), F.col("_s.role"), "pos", "date").where("role is not null")
    enough = F.sum((F.col("role") == "train").cast("int")).over(Window.partitionBy("split_id")) >= c.min_train_size
    return long.withColumn("_ok", enough).where("_ok").drop("_ok")


def split_features(features: DataFrame, splits: DataFrame, split_id: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one fold."""
    own = splits.where(F.col("split_id") == split_id)
    part = lambda role: features.join(F.broadcast(own.where(F.col("role") == role).select("date")), "date", "left_semi")
    return part("train"), part("test")


class PurgedWalkForwardSplit:
    """The folds one after the other, for loops over training and test tables."""

    def __init__(self, config: SplitConfig | None = None) -> None:
        self.config = config or SplitConfig()

    def get_n_splits(self) -> int:
        return self.config.n_splits

    def split(self, features: DataFrame):
        names = ["date", *(["label_end"] if "label_end" in features.columns else [])]
        splits = purged_walk_forward_splits(features.select(*names), self.config).persist()
        try:
            for row in splits.select("split_id").distinct().orderBy("split_id").collect():
                yield split_features(features, splits, row["split_id"])
        finally:  # also when the loop is left early; tables that were handed out stay valid and are worked out anew
            splits.unpersist()

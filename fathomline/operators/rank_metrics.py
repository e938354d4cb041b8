"""How well scores rank later returns: rank IC by date, top and bottom buckets, and their summaries.

scores: (date, asset, score [, asset_order]); returns: (date, asset, forward_return); benchmark: (date, benchmark_return). Of equal scores, the asset of the smaller asset_order (of the
smaller name, where there is none) comes first in either direction. A date may have any number of assets: ranks and places are found in two levels (ranks.py), so that no task holds a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.expr import correlation, number
from fathomline.operators.ranks import places, with_average_rank
from fathomline.sources.shared import written


def aligned(scores: DataFrame, returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    order = F.col("asset_order") if "asset_order" in scores.columns else F.col("asset")
    rows = scores.select("date", "asset", number(F.col("score")).alias("score"), order.alias("asset_order")).join(returns.select("date", "asset", number(F.col("forward_return")).alias("outcome")), ["date", "asset"])
    if benchmark is not None:
        rows = rows.join(benchmark.select("date", "benchmark_return"), "date", "left").withColumn("outcome", F.col("outcome") - F.col("benchmark_return")).drop("benchmark_return")
    return rows


def rank_ic_by_date(scores: DataFrame, returns: DataFrame, min_assets: int = 3, method: str = "spearman") -> DataFrame:
    """date, rank_ic, n: Spearman's (or Pearson's) correlation over the assets that have both; null with fewer than min_assets, or if one side doesn't vary."""
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be 'spearman' or 'pearson'")
    rows = aligned(scores, returns)
    dates = rows.select("date").distinct()
    pairs = rows.dropna(subset=["score", "outcome"])
    if method == "spearman":
        pairs = with_average_rank(written(pairs.select("date", "score", "outcome"), "rank-pairs"), "score", ["date"], "_score")
        pairs = with_average_rank(pairs, "outcome", ["date"], "_outcome").select("date", F.col("_score").alias("score"), F.col("_outcome").alias("outcome"))
    ic = pairs.groupBy("date").agg(correlation("score", "outcome").alias("_ic"), F.count("*").alias("n"))
    return dates.join(ic, "date", "left").select("date", F.when(F.col("n") >= min_assets, F.col("_ic")).alias("rank_ic"), F.coalesce("n", F.lit(0)).alias("n"))


def buckets_by_date(scores: DataFrame, returns: DataFrame, benchmark: DataFrame | None = None, top_fraction: float = 0.20, bottom_fraction: float = 0.20, min_assets: int = 3) -> DataFrame:
    """Means, spreads and hit rates of the top and bottom buckets of each date."""
    if not (0 < top_fraction <= 1 and 0 < bottom_fraction <= 1):
        raise ValueError("top_fraction and bottom_fraction must lie in (0, 1]")
    rows = aligned(scores, returns, benchmark)
    dates = rows.select("date").distinct()
    pairs = written(rows.dropna(subset=["score", "outcome"]).select("date", "outcome", "score", "asset_order"), "rank-pairs")

    def bucket(score, share: float, name: str) -> DataFrame:
        """Of each date the share of rows that come first by score, then asset_order: their mean, hit rate and number; of rows that are alike as many as still fit."""
        table = places(pairs, F.struct(score.alias("score"), "asset_order", "outcome"), ["date"])
        size = F.greatest(F.lit(1.0), F.ceil(F.col("_of") * F.lit(float(share))).cast("double")).cast("bigint")
        held = F.greatest(F.lit(0), F.least(F.col("_same"), size - F.col("_before")))
        outcome = F.col("_value.outcome")
        mean = lambda w, x: F.try_divide(F.sum(w * x), F.sum(w))
        return table.groupBy(F.col("_by0").alias("date")).agg(
            mean(held, outcome).alias(f"{name}_mean"),
            mean(held, F.when(outcome > 0, 1.0).otherwise(0.0)).alias(f"{name}_hit"),
            F.sum(held).alias(f"{name}_n"),
            mean(F.col("_same"), outcome).alias(f"{name}_all"),
            F.sum("_same").alias(f"{name}_rows"),
        )

    own = bucket(-F.col("score"), top_fraction, "top").withColumnsRenamed({"top_all": "universe_mean", "top_rows": "n"}).join(bucket(F.col("score"), bottom_fraction, "bottom"), "date")
    enough = F.col("n") >= min_assets
    rows = dates.join(own, "date", "left")
    keep = lambda c: F.when(enough, c)
    return rows.select(
        "date",
        *(keep(F.col(c)).alias(c) for c in ("top_mean", "bottom_mean", "universe_mean")),
        keep(F.col("top_mean") - F.col("bottom_mean")).alias("spread"),
        keep(F.col("top_mean") - F.col("universe_mean")).alias("top_universe_spread"),
        *(keep(F.col(c)).alias(c) for c in ("top_hit", "bottom_hit")),
        F.coalesce("n", F.lit(0)).alias("n"),
        *(F.when(enough, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("top_n", "bottom_n")),
    )


def rank_ic_summary(by_date: DataFrame) -> DataFrame:
    """Mean, median, deviation (0 for a single date), ratio and count of the dates' rank IC."""
    n = F.count("rank_ic")
    std = F.stddev_samp("rank_ic")
    return by_date.agg(
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.median("rank_ic").alias("rank_ic_median"),
        F.when(n > 1, std).when(n == 1, 0.0).alias("rank_ic_std"),
        F.when((n > 1) & (std > 0), F.try_divide(F.avg("rank_ic"), std)).alias("rank_ic_ir"),
        n.alias("rank_ic_count"),
    )


def bucket_summary(by_date: DataFrame) -> DataFrame:
    """Means and medians over the dates that have buckets."""
    return by_date.agg(
        F.avg("spread").alias("top_bottom_spread"),
        F.median("spread").alias("top_bottom_spread_median"),
        F.avg("top_universe_spread").alias("top_minus_universe_excess"),
        F.median("top_universe_spread").alias("top_minus_universe_excess_median"),
        F.avg("top_mean").alias("top_mean_return"),
        F.avg("bottom_mean").alias("bottom_mean_return"),
        F.avg("top_hit").alias("top_hit_rate"),
        F.avg("bottom_hit").alias("bottom_hit_rate"),
        F.avg("top_hit").alias("hit_rate"),
        F.count("spread").alias("observations"),
    )


def evaluate_rank_metrics(scores: DataFrame, returns: DataFrame, benchmark: DataFrame | None = None, min_assets: int = 3, top_fraction: float = 0.20, bottom_fraction: float = 0.20, method: str = "spearman") -> DataFrame:
    """Both summaries in one row."""
    ic = rank_ic_summary(rank_ic_by_date(scores, returns, min_assets, method))
    return ic.join(F.broadcast(bucket_summary(buckets_by_date(scores, returns, benchmark, top_fraction, bottom_fraction, min_assets))), F.lit(True))

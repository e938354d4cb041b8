"""Ranks in two levels against pandas: ties, nulls, one wide date; buckets with rows that are alike."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.operators import rank_metrics
from fathomline.operators.ranks import places, with_average_rank


def test_ranks_of_one_wide_group(spark):
    """One date has nearly all of 200,000 rows, half of them one value: the same ranks as pandas', and its counts lie in many slices."""
    rows = spark.range(200_000).select(
        "id",
        F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise(F.lit("2024-01-05")).alias("date"),
        F.when(F.col("id") % 17 == 0, F.lit(None).cast("double")).when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise((F.xxhash64("id") % 60_000) / 7).alias("x"),
    )
    got = with_average_rank(with_average_rank(rows, "x", ["date"], "rank", slices=8), "x", ["date"], "share", share=True, slices=8).toPandas().sort_values("id")
    by = got.fillna({"date": "none"}).groupby("date")["x"]
    assert len(got) == 200_000 and got["rank"].isna().sum() == got["x"].isna().sum()
    np.testing.assert_array_equal(got["rank"], by.rank(method="average"))
    np.testing.assert_allclose(got["share"], by.rank(method="average", pct=True), rtol=1e-12)
    # repartitionByRange cuts the one date; a slice is a task of the window over it
    table = places(rows, F.col("x"), ["date"], 8)
    assert table.where("_before = 0").count() == 2 and table.agg(F.sum("_same")).first()[0] == got["x"].notna().sum()


def test_edges(spark):
    kind = "date string, x double, _own string"
    rows = spark.createDataFrame([("a", 2.0, "r"), ("a", 2.0, "r"), ("a", None, "s"), ("b", -0.0, "t"), ("b", 0.0, "t")], kind).withColumnRenamed("_own", "extra")
    got = sorted(tuple(r) for r in with_average_rank(rows, "x", ["date"], "r").select("date", F.coalesce("x", F.lit(9.0)), F.coalesce("r", F.lit(-1.0))).collect())
    assert got == [("a", 2.0, 1.5), ("a", 2.0, 1.5), ("a", 9.0, -1.0), ("b", 0.0, 1.5), ("b", 0.0, 1.5)]
    assert with_average_rank(rows.limit(0), "x", ["date"], "r").count() == 0


def test_buckets_of_a_wide_date(spark):
    """20,000 assets of one date, with ties and rows that are alike, against a sort in pandas."""
    rng = np.random.default_rng(3)
    n = 20_000
    scores = pd.DataFrame({"date": "2024-01-05", "asset": [f"a{i:05d}" for i in range(n)], "score": rng.integers(0, 50, n) / 10})
    returns = pd.DataFrame({"date": "2024-01-05", "asset": scores.asset, "forward_return": rng.normal(size=n)})
    returns = pd.concat([returns, returns[:300]])  # repeated rows count as often as they occur
    got = rank_metrics.buckets_by_date(spark.createDataFrame(scores), spark.createDataFrame(returns), top_fraction=0.1, bottom_fraction=0.3).first()
    rows = scores.merge(returns, on=["date", "asset"])
    top = rows.sort_values(["score", "asset"], ascending=[False, True]).head(-(-len(rows) // 10))
    bottom = rows.sort_values(["score", "asset"]).head(-(-len(rows) * 3 // 10))
    assert (got.n, got.top_n, got.bottom_n) == (len(rows), len(top), len(bottom))
    assert got.top_mean == pytest.approx(top.forward_return.mean()) and got.bottom_mean == pytest.approx(bottom.forward_return.mean())
    assert got.top_hit == pytest.approx((top.forward_return > 0).mean()) and got.universe_mean == pytest.approx(rows.forward_return.mean())
    ic = rank_metrics.rank_ic_by_date(spark.createDataFrame(scores), spark.createDataFrame(returns)).first()
    assert ic.rank_ic == pytest.approx(rows["score"].rank().corr(rows["forward_return"].rank()))

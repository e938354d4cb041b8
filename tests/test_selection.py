"""Exact medians by histograms, and episodes by pointers, against plain versions."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline.operators.asof import first_at_or_after
from fathomline.operators.episodes import detect_episodes
from fathomline.operators.selection import exact_medians

START = datetime(2001, 1, 1)


def test_medians(spark):
    rng = random.Random(3)
    columns = {
        "ties": [float(rng.randrange(4)) for _ in range(1001)],
        "even": [rng.gauss(0, 1) for _ in range(1000)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-20, 20) for _ in range(999)],
        "huge": [-1.7e308, 1.7e308, 1.0, 2.0, None, 5.0],
        "same": [7.5] * 50,
        "one": [3.0, None, float("nan")],
        "none": [None],
    }
    n = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
    found = exact_medians(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)), list(columns))
    for c, v in columns.items():
        own = [x for x in v if x is not None and x == x]
        assert found[c] == (pytest.approx(statistics.median(own), rel=1e-15) if own else None), c


def test_medians_of_many_rows(spark):
    df = spark.range(500_001).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    assert exact_medians(df, ["x"])["x"] == df.agg(F.median("x")).first()[0]


def test_first_at_or_after(spark):
    rng = random.Random(1)
    facts = [(rng.choice("ab"), START + timedelta(hours=rng.randrange(20000)), rng.randrange(9)) for _ in range(300)]
    asks = [(i, rng.choice("abc"), START + timedelta(hours=rng.randrange(-500, 21000))) for i in range(300)]
    right = spark.createDataFrame(facts, "theme string, ts timestamp_ntz, v int")
    left = spark.createDataFrame(asks, "i int, theme string, at timestamp_ntz")
    found = {r.i: r.found for r in first_at_or_after(left, right, "theme", "at", "ts", F.col("v"), "found", 3).collect()}
    for i, by, at in asks:
        own = [(t, v) for b, t, v in facts if b == by and t >= at]
        assert found[i] == (min(own)[1] if own else None)


def plain_episodes(rows, gap):
    out, last = {}, {}
    for theme, at, end in sorted((r for r in rows if r[0] is not None)):
        if theme not in last or (at - last[theme][0] >= gap and at > last[theme][1]):
            last[theme] = (at, end)
            out[theme, at] = sum(t == theme for t, _ in out) + 1
    return out


@pytest.mark.parametrize("weeks", [1, 13])
def test_episodes(spark, weeks):
    rng = random.Random(weeks)
    rows = []
    for theme in ("a", "a", "b", "c", None):
        for _ in range(200):
            at = START + timedelta(days=rng.randrange(3000))
            rows.append((theme, at, at + timedelta(days=rng.randrange(0, 150))))
    rows = sorted({(t or "", a): (t, a, e) for t, a, e in rows}.values(), key=str)
    df = spark.createDataFrame([(*r, True, i) for i, r in enumerate(rows)] + [("a", START, START, False, -1)], "theme string, decision_at timestamp_ntz, end timestamp_ntz, qualifies boolean, i int")
    found = detect_episodes(df, weeks)
    assert {(r.theme, r.start): r.episode_id for r in found.collect()} == plain_episodes(rows, timedelta(weeks=weeks))
    assert detect_episodes(df.where("not qualifies"), weeks).count() == 0


def test_a_theme_of_many_decisions(spark):
    """100,000 qualifying decisions of one theme, an hour apart, each over after five: every sixth starts an episode."""
    df = spark.range(100_000).select(F.lit("one").alias("theme"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("decision_at"), F.timestamp_seconds(F.col("id") * 3600 + 5 * 3600).cast("timestamp_ntz").alias("end"), F.lit(True).alias("qualifies"), "id")
    found = detect_episodes(df, 0).agg(F.count("*"), F.max("episode_id"), F.count_if(F.col("id") % 6 == 0), F.count_if(F.col("id") == 6 * (F.col("episode_id") - 1))).first()
    assert tuple(found) == (16_667, 16_667, 16_667, 16_667)

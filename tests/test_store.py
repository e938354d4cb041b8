"""The observation store and runs that go on from kept metrics, against full runs over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline.config import PanelConfig
from fathomline.operators.metrics import theme_metrics
from fathomline.operators.panel import Panel, normalised, weekly_observations
from fathomline.plans.incremental import refreshed_metrics, run_from_store
from fathomline.plans.pipeline import AvailabilityError, run_signal_pipeline
from fathomline.sources.shared import scratch
from fathomline.sources.store import ObservationStore

SCHEMA = "date timestamp_ntz, theme string, security string, value double, n long"


def prices(weeks=90, seed=5):
    """Three themes with gaps, a late member, hours within a day, values that aren't prices, and the benchmark."""
    draw, out = random.Random(seed), []
    for w in range(weeks):
        day = datetime(2020, 1, 2) + timedelta(weeks=w)
        out.append((day, "__market__", "SPY", 100 + w + draw.random(), len(out)))
        for theme, members in (("a", "xyz"), ("b", "uv"), ("c", "pq")):
            for m in members:
                if draw.random() < 0.9 and not (m == "z" and w < 40):
                    for h in (0, 9):
                        out.append((day + timedelta(days=draw.randint(-2, 3), hours=h), theme, m, draw.choice([50 + 20 * draw.random()] * 9 + [-1.0]), len(out)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(left, right):
    keys = ["theme", "week"]
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (left, right.select(*left.columns)))
    assert len(a) == len(b) > 0
    for name in a.columns:
        one, two = a[name], b[name]
        assert (one.isna() == two.isna()).all(), name
        if one.dtype == float:
            assert ((one - two).abs().fillna(0) <= 1e-9 * (1 + two.abs().fillna(0))).all(), name
        else:
            assert (one.fillna(0) == two.fillna(0)).all(), name


def test_batches_make_the_state_of_all_rows(spark):
    rows, store = prices(), ObservationStore(spark, scratch(spark), buckets=4)
    mixed = random.Random(1).sample(rows, len(rows))
    third = len(rows) // 3
    for part in (mixed[:third], mixed[third : 2 * third], mixed[2 * third :], mixed[:third]):  # one comes twice
        store.append(frame(spark, part), "n")
    want = lambda own: {tuple(r) for r in weekly_observations(normalised(frame(spark, own), "n")).collect()}
    assert {tuple(r) for r in store.observed().collect()} == want(rows)
    limit = datetime(2020, 9, 3)
    assert {tuple(r) for r in store.observed("2020-09-03").collect()} == want([r for r in rows if r[0] <= limit])
    old = store.observed()
    store.compact()
    assert {tuple(r) for r in old.collect()} == want(rows) and store.clean() == 1
    assert {tuple(r) for r in store.observed().collect()} == want(rows)
    again = ObservationStore(spark, store.path, buckets=16)
    assert again.buckets == 4 and {tuple(r) for r in again.observed().collect()} == want(rows)
    assert store.append(frame(spark, [])) is None
    with pytest.raises(AvailabilityError):
        store.append(frame(spark, rows[:5]).withColumn("available_at", F.col("date") + F.expr("interval 3 days")))


def test_scans_are_pruned_and_need_no_exchange(spark):
    store = ObservationStore(spark, scratch(spark), buckets=4)
    store.append(frame(spark, prices()), "n")
    plan = store.observed("2020-06-30", first="2020-03-01")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(period" in plan
    few, all_ = (x.select(F.input_file_name()).distinct().count() for x in (store.state("2020-06-30", first="2020-03-01"), store.state()))
    assert 0 < few < all_ / 3


@pytest.mark.parametrize("late", [False, True])
def test_refreshed_metrics_equal_a_full_run(spark, late):
    rows = sorted(prices(), key=lambda r: r[0])
    store = ObservationStore(spark, scratch(spark), buckets=4)
    held = {i for i in range(len(rows)) if late and 60 * 8 < i and i % 97 == 5}
    start = int(len(rows) * 0.8)
    store.append(frame(spark, [r for i, r in enumerate(rows[:start]) if i not in held]), "n")
    assert refreshed_metrics(store)[1] is not None and refreshed_metrics(store)[1] is None
    store.append(frame(spark, [r for i, r in enumerate(rows) if i >= start or i in held]), "n")
    got, since = refreshed_metrics(store)
    until = store.last_day()
    assert since > datetime(2020, 6, 1).date()
    same(got, theme_metrics(Panel(frame(spark, [r for r in rows if r[0] <= until]), PanelConfig(), "n")))
    store.forget(store.changes())
    assert store.changes() == {}
    earlier, _ = refreshed_metrics(store, as_of="2021-03-05")
    same(earlier, theme_metrics(Panel(frame(spark, [r for r in rows if r[0] <= datetime(2021, 3, 5)]), PanelConfig(), "n")))


def test_a_new_theme_and_another_setting_are_made_in_full(spark):
    rows = sorted(prices(70), key=lambda r: r[0])
    store = ObservationStore(spark, scratch(spark), buckets=4)
    store.append(frame(spark, [r for r in rows if r[1] != "c"]), "n")
    refreshed_metrics(store)
    store.append(frame(spark, [r for r in rows if r[1] == "c"][-20:]), "n")
    own = [r for r in rows if r[1] != "c"] + [r for r in rows if r[1] == "c"][-20:]
    got, _ = refreshed_metrics(store)
    same(got, theme_metrics(Panel(frame(spark, [r for r in own if r[0] <= store.last_day()]), PanelConfig(), "n")))
    with pytest.raises(ValueError, match="store keeps"):
        refreshed_metrics(store, PanelConfig(min_value=2.0))


def test_run_from_store_equals_the_pipeline(spark):
    rows = prices(70)
    one, two = (ObservationStore(spark, scratch(spark), buckets=4) for _ in range(2))
    one.append(frame(spark, rows), "n")
    for part in (rows[::2], rows[1::2]):
        two.append(frame(spark, part), "n")
    a, b, whole = run_from_store(one, "2021-04-02"), run_from_store(two, "2021-04-02"), run_signal_pipeline(frame(spark, rows), "2021-04-02", row_order="n")
    assert a.as_of == whole.as_of and a.fingerprint.collect() == b.fingerprint.collect() != run_from_store(one, "2021-03-26").fingerprint.collect()
    key = lambda run: sorted(map(tuple, run.manifest().collect()))
    assert key(a) == key(b) == key(whole)

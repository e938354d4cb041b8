"""Labels, episodes, early hits, rank metrics, audits, splits and memberships."""

import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.config import EarlyHitConfig, EpisodeConfig, SplitConfig
from fathomline.operators import audits, early_hits, episodes, labels, membership, rank_metrics, splits

START = datetime(2020, 1, 3)
AT = [START + timedelta(weeks=i) for i in range(200)]


def series(spark, prices, bench=None, theme="t", at=None):
    at = at or AT
    rows = [(theme, at[i], None if p is None else float(p), float(bench[i]) if bench is not None else 100.0) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "theme string, ts timestamp_ntz, price double, b_price double")


def test_labels_take_the_next_session(spark):
    rows = {r.decision_at: r for r in labels.future_labels(series(spark, range(100, 170)), (13,)).collect()}
    first = rows[AT[0]]
    assert first.entry_at_13w == AT[1] and first.exit_at_13w == AT[14] and first.future_13w_return == pytest.approx(114 / 101 - 1)
    assert first.label_13w is False and rows[AT[69]].label_13w is None and rows[AT[57]].label_13w is None


def test_labels_against_a_parent_sector(spark):
    rows = series(spark, range(100, 170)).withColumn("parent_price", F.when(F.col("ts") != F.lit(AT[3]), F.col("price") * 2 + 10))
    got = {r.decision_at: r.future_13w_parent_sector_excess_return for r in labels.future_labels(rows, (13,)).collect()}
    assert got[AT[0]] == pytest.approx(114 / 101 - (2 * 114 + 10) / (2 * 101 + 10)) and got[AT[2]] is None and len(got) == 70


def test_labels_with_gaps_against_brute_force(spark):
    rng = np.random.default_rng(4)
    keep = sorted(rng.choice(150, 110, replace=False))
    at, prices = [AT[i] for i in keep], rng.uniform(50, 150, 110).round(1)
    rows = {r.decision_at: r for r in labels.future_labels(series(spark, prices, at=at), (13, 26), absolute_threshold=None, excess_threshold=None).collect()}
    for i, t in enumerate(at):
        for h in (13, 26):
            e = i + 1 if i + 1 < len(at) else None
            x = next((j for j in range(len(at)) if e is not None and at[j] >= at[e] + timedelta(weeks=h)), None)
            assert rows[t][f"exit_at_{h}w"] == (None if x is None else at[x])
            if x is not None:
                path = prices[e : x + 1]
                assert rows[t][f"future_{h}w_return"] == pytest.approx(path[-1] / path[0] - 1)
                assert rows[t][f"future_{h}w_max_relative_drawdown"] == pytest.approx((path / np.maximum.accumulate(path) - 1).min())


def test_panel_labels(spark):
    three = series(spark, np.linspace(100, 200, 60), theme="up").union(series(spark, np.linspace(100, 110, 60), theme="slow")).union(series(spark, np.linspace(100, 60, 60), theme="down"))
    rows = {r.theme: r for r in labels.future_panel_labels(three, (13,)).where(F.col("decision_at") == F.lit(AT[5])).collect()}
    assert rows["up"].leader_13w and not rows["slow"].leader_13w and not rows["down"].leader_13w and rows["up"].future_13w_return_rank == 1.0


def test_move_classes(spark):
    moves = spark.createDataFrame([(0.8, 0.4, 0.6, 4), (1.0, 0.7, 0.6, 4), (1.2, 0.1, 0.7, 5), (1.2, None, 0.7, 5), (1.2, 0.1, None, 5), (1.2, 0.1, 0.7, 3)], "theme_return double, spy_return double, breadth_up double, active_names bigint")
    assert [r.label for r in labels.classify_moves(moves).collect()] == ["major_surge", "none", "explosive", "none", "none", "none"]


def brute_measure(prices, at, c):
    out = []
    n = len(prices)
    after = lambda p, h: next((j for j in range(n) if at[j] >= at[p] + timedelta(weeks=h)), None) if p is not None else None
    for i in range(n):
        entry = i + 1 if i + 1 < n else None
        terminal = after(entry, c.horizon_weeks)
        if terminal is None:
            out.append(None)
            continue
        crossing = onset = None
        for p in range(entry, terminal + 1):
            lo = max(0, p - c.onset_weeks)
            low = lo + int(np.argmin(prices[lo : p + 1]))
            if prices[low] > 0 and prices[p] / prices[low] - 1 >= c.major_return:
                crossing, onset = p, low
                break
        if crossing is None:
            end = entry + int(np.argmax(prices[entry : terminal + 1]))
            out.append((entry, entry, None, end))
        else:
            until = after(crossing, c.horizon_weeks)
            until = terminal if until is None else until
            out.append((entry, onset, crossing, crossing + int(np.argmax(prices[crossing : until + 1]))))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_episode_positions_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    keep = sorted(rng.choice(170, 140, replace=False))
    at = [AT[i] for i in keep]
    prices = np.round(100 * np.cumprod(1 + rng.choice([-0.06, 0, 0.02, 0.07], 140)), 0)
    c = EpisodeConfig(major_return=0.3, horizon_weeks=20, onset_weeks=10)
    rows = {r.decision_at: r for r in episodes.measured(series(spark, prices, at=at), c).collect()}
    for t, want in zip(at, brute_measure(prices, at, c), strict=True):
        r = rows[t]
        assert r.matured == (want is not None)
        if want:
            entry, onset, crossing, end = want
            assert (r.entry.pos, r.onset.pos, r.crossing.pos if r.crossing else None, r.end.pos) == (entry, onset, crossing, end), t
            assert r.theme_return == pytest.approx(prices[end] / prices[onset] - 1)


def test_dense_series(spark):
    """10,000 observations a theme, six a day: a horizon has over a thousand rows, and takes no list of them."""
    n = 10_000
    rng = np.random.default_rng(7)
    at = [START + timedelta(hours=4 * i) for i in range(n) if i % 1000 < 900]  # with gaps
    prices = np.round(100 * np.cumprod(1 + rng.normal(0, 0.01, len(at))), 2)
    rows = series(spark, prices, bench=np.full(len(at), 100.0), at=at)
    began = time.time()
    got = {r.decision_at: r for r in labels.future_labels(rows, (13, 26), absolute_threshold=None, excess_threshold=None).collect()}
    c = EpisodeConfig(major_return=0.3, horizon_weeks=20, onset_weeks=40)
    found = {r.decision_at: r for r in episodes.measured(rows, c).collect()}
    assert time.time() - began < 60
    seconds = np.array([t.timestamp() for t in at])
    after = lambda p, h: int(np.searchsorted(seconds, seconds[p] + h * 7 * 86400))
    low = np.array([p - c.onset_weeks + int(np.argmin(prices[p - c.onset_weeks : p + 1])) if p >= c.onset_weeks else int(np.argmin(prices[: p + 1])) for p in range(len(at))])
    crosses = prices / prices[low] - 1 >= c.major_return
    for i in [*range(0, len(at) - 1, 97), *range(len(at) - 900, len(at) - 1, 13)]:
        for h in (13, 26):
            e, x = i + 1, after(i + 1, h)
            fall = got[at[i]][f"future_{h}w_max_relative_drawdown"]
            if x == len(at):
                assert fall is None
            else:
                path = prices[e : x + 1]
                assert fall == pytest.approx((path / np.maximum.accumulate(path) - 1).min())
        e, terminal = i + 1, after(i + 1, 20)
        if terminal == len(at):
            assert not found[at[i]].matured
            continue
        crossing = next((p for p in range(e, terminal + 1) if crosses[p]), None)
        last = terminal if crossing is None or after(crossing, 20) == len(at) else after(crossing, 20)
        begin = e if crossing is None else crossing
        r = found[at[i]]
        assert (r.crossing.pos if r.crossing else None) == crossing and r.end.ts == at[begin + int(np.argmax(prices[begin : last + 1]))]


def test_early_hit_options(spark):
    prices = [100.0] * 31 + [100 * 1.02**i for i in range(1, 41)] + [100 * 1.02**40] * 60
    signals = spark.createDataFrame([("t", AT[i], i in (33, 34, 36, 37, 50)) for i in range(120)], "theme string, decision_at timestamp_ntz, signal boolean")
    rows = lambda **k: {r.decision_at: r for r in early_hits.evaluate_early_hits(signals, series(spark, prices), **k).collect()}
    alone = rows()
    assert not any(r.hit or r.eligible_for_early_hit or r.event_metadata_available for r in alone.values()) and alone[AT[36]].persistent
    strict = rows(config=EarlyHitConfig(persistence_window=None))
    assert strict[AT[34]].persistent and not strict[AT[36]].persistent and strict[AT[37]].persistent
    starts = spark.createDataFrame([("t", AT[i], AT[30]) for i in range(120)], "theme string, decision_at timestamp_ntz, onset timestamp_ntz")
    peaks = spark.createDataFrame([("t", AT[i], AT[70]) for i in range(120)], "theme string, decision_at timestamp_ntz, peak timestamp_ntz")
    given = rows(starts=starts, peaks=peaks, absolute_threshold=0.5, excess_threshold=None)
    assert given[AT[34]].hit and given[AT[34]].realized_log_fraction == pytest.approx(4 / 40) and sum(r.hit for r in given.values()) == 1
    late = EarlyHitConfig(log_fraction=None, weeks_after=60, persistence_count=1, persistence_window=None)
    assert rows(starts=starts, peaks=peaks, absolute_threshold=0.1, excess_threshold=None, config=late)[AT[50]].within_realized_limit
    same_day = rows(config=EarlyHitConfig(next_session=False))
    assert same_day[AT[10]].entry_at == AT[10] and alone[AT[10]].entry_at == AT[11]


def test_episode_settings():
    nested = {"major_surge": {"min_theme_gain": 0.7, "min_valid_names": 3, "min_breadth_beat_spy": 0.4}, "explosive": {"min_theme_gain": 1.5}, "onset": {"lookback_weeks": 20, "merge_gap_weeks": 0}}
    c = EpisodeConfig.from_mapping(nested)
    assert (c.major_return, c.min_names, c.min_beat_breadth, c.explosive_return, c.onset_weeks, c.merge_gap_weeks, c.horizon_weeks) == (0.7, 3, 0.4, 1.5, 20, 0, 52)
    assert EpisodeConfig.from_mapping(c.to_mapping()) == c and EpisodeConfig.from_mapping({}) == EpisodeConfig()
    for bad in (dict(min_breadth=1.1), dict(horizon_weeks=0), dict(min_names=-1), dict(merge_gap_weeks=-1), dict(major_return=float("nan")), dict(min_rank=2)):
        with pytest.raises(ValueError):
            EpisodeConfig(**bad)
    for bad in (dict(persistence_count=0), dict(persistence_window=1), dict(weeks_before=-1)):
        with pytest.raises(ValueError):
            EarlyHitConfig(**bad)


def test_episodes_merge(spark):
    prices = [100.0] * 10 + [100 * 1.1**i for i in range(1, 15)] + [380.0] * 60
    facts = spark.createDataFrame([("t", AT[i], 0.9, 5) for i in range(len(prices))], "theme string, decision_at timestamp_ntz, breadth_up double, active_names bigint")
    rows = episodes.label_episodes(series(spark, prices), facts, EpisodeConfig(horizon_weeks=26))
    assert {r.label for r in rows.collect()} >= {"explosive", "none", None}
    found = episodes.detect_episodes(rows).collect()
    assert len(found) >= 1 and sorted(r.episode_id for r in found) == list(range(1, len(found) + 1))
    starts = sorted((r.start, r.end) for r in found)
    assert all(b[0] - a[0] >= timedelta(weeks=13) and b[0] > a[1] for a, b in zip(starts, starts[1:], strict=False))


def test_early_hits(spark):
    prices = [100.0] * 31 + [100 * 1.02**i for i in range(1, 41)] + [100 * 1.02**40] * 60
    events = spark.createDataFrame([("t", AT[30], AT[70], True)], "theme string, onset timestamp_ntz, peak timestamp_ntz, qualifies boolean")
    signals = spark.createDataFrame([("t", AT[i], i in (33, 34, 50)) for i in range(120)], "theme string, decision_at timestamp_ntz, signal boolean")
    rows = {r.decision_at: r for r in early_hits.evaluate_early_hits(signals, series(spark, prices), events, EarlyHitConfig()).collect()}
    hit = rows[AT[34]]
    assert hit.hit and hit.first_signal and hit.realized_log_fraction == pytest.approx(4 / 40) and hit.within_onset_window
    assert not rows[AT[33]].persistent and not rows[AT[50]].persistent and sum(r.hit for r in rows.values()) == 1
    report = early_hits.early_hit_report(spark.createDataFrame(list(rows.values()))).first()
    assert (report.eligible, report.hits, report.hit_rate, report.median_lead_lag_weeks) == (1, 1, 1.0, 4.0)
    late = signals.withColumn("feature_available_at", F.col("decision_at") + F.expr("interval 1 day"))
    assert not any(r.hit for r in early_hits.evaluate_early_hits(late, series(spark, prices), events, EarlyHitConfig()).collect())


def test_rank_metrics(spark):
    rows = [(date(2024, 1, d), a, float(s), 0.1 * s) for d in (1, 2, 3) for s, a in enumerate("abc")]
    scores = spark.createDataFrame([r[:3] for r in rows], "date date, asset string, score double")
    returns = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "date date, asset string, forward_return double")
    report = rank_metrics.evaluate_rank_metrics(scores, returns).first()
    assert report.rank_ic_mean == pytest.approx(1) and report.rank_ic_std == pytest.approx(0) and report.rank_ic_count == 3 and report.top_bottom_spread == pytest.approx(0.2)
    flat = scores.withColumn("score", F.lit(1.0))
    assert [r.rank_ic for r in rank_metrics.rank_ic_by_date(flat, returns).collect()] == [None] * 3
    assert {r.n for r in rank_metrics.buckets_by_date(flat, returns).collect()} == {3}


def test_audits(spark):
    day = datetime(2024, 1, 5)
    rows = [(day, day + timedelta(days=1), "A", 0.5, "etf", 10), (day, day, "A", 0.99, "etf", 60), (day, None, "B", None, "stock", 1)]
    df = spark.createDataFrame(rows, "decision_at timestamp_ntz, feature_available_at timestamp_ntz, symbol string, coverage double, asset_type string, history_weeks int")
    members = spark.createDataFrame([("A", date(2024, 1, 6), None), ("B", date(2023, 1, 1), date(2024, 1, 5))], "symbol string, start date, end date")
    found = {r["code"]: r["count"] for r in audits.audit_integrity(df, memberships=members).collect()}
    assert found == {"feature_after_decision": 1, "invalid_feature_timestamp": 1, "insufficient_coverage": 2, "insufficient_etf_history": 1, "membership_out_of_range": 2, "duplicate_feature_key": 2}
    with pytest.raises(audits.IntegrityError):
        audits.assert_integrity(df)
    assert {r["code"] for r in audits.audit_integrity(df.drop("coverage", "feature_available_at")).collect()} >= {"missing_coverage", "missing_feature_available_at"}


def test_splits(spark):
    dates = spark.createDataFrame([(AT[i], AT[i] + timedelta(weeks=3)) for i in range(40)], "date timestamp_ntz, label_end timestamp_ntz")
    rows = splits.purged_walk_forward_splits(dates, SplitConfig(n_splits=3, test_size=5, embargo=2)).collect()
    for k in range(3):
        test = sorted(r.pos for r in rows if r.split_id == k and r.role == "test")
        train = sorted(r.pos for r in rows if r.split_id == k and r.role == "train")
        assert test == list(range(25 + 5 * k, 30 + 5 * k)) and max(train) + 3 < test[0] and max(train) < test[0] - 2
    with pytest.raises(ValueError):
        splits.purged_walk_forward_splits(dates.limit(3), SplitConfig(n_splits=5))
    train, test = splits.split_features(dates, splits.purged_walk_forward_splits(dates, SplitConfig(n_splits=3, test_size=5)), 0)
    assert test.count() == 5 and train.count() > 10
    folds = list(splits.PurgedWalkForwardSplit(SplitConfig(n_splits=3, test_size=5)).split(dates))
    assert len(folds) == 3 and [t.count() for _, t in folds] == [5, 5, 5]


def test_memberships(spark):
    schema = "theme_id string, permanent_id string, symbol string, valid_from date, valid_to date, evidence_available_at date, exposure_tier string, confidence double"
    df = spark.createDataFrame([("solar", "AAA", "AAA", date(2020, 1, 1), date(2021, 1, 1), date(2020, 2, 1), "core", 0.9)], schema)
    count = lambda day, **k: membership.memberships_as_of(df, day, **k).count()
    assert [count(d) for d in ("2020-01-15", "2020-02-01", "2020-12-31", "2021-01-01")] == [0, 1, 1, 0] and count("2020-06-01", tiers=["other"]) == 0
    with pytest.raises(membership.LookaheadError):
        count("2020-01-15", strict=True)
    both = df.union(df.withColumn("valid_from", F.lit(date(2020, 6, 1))))
    with pytest.raises(membership.MembershipConflictError):
        membership.validate_memberships(both)
    membership.validate_memberships(df)

"""Panels and lanes: invariants on small panels, and an independent pandas oracle with gaps, ties, late members and duplicates."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.config import CurrentLeaderConfig, EmergingRadarConfig, PanelConfig
from fathomline.operators import metrics
from fathomline.operators.panel import Panel, normalised
from fathomline.plans import annual, lanes, pipeline

START = datetime(2023, 1, 6)
SCHEMA = "date timestamp_ntz, theme string, security string, value double"
RATES = {("Leader", "L1"): 0.015, ("Leader", "L2"): 0.014, ("Leader", "L3"): 0.016, ("Laggard", "G1"): 0.002, ("Laggard", "G2"): 0.003, ("Laggard", "G3"): 0.001, ("__market__", "spy"): 0.005}


def growth_panel(weeks=80, rates=RATES, extra=()):
    return [(START + timedelta(weeks=i), t, s, 100 * (1 + r) ** i) for (t, s), r in rates.items() for i in range(weeks)] + list(extra)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lane(spark, rows, which=lanes.current_leader, config=None, as_of=None):
    out = which(metrics.theme_metrics(Panel(frame(spark, rows), config or PanelConfig())), config, as_of)
    return {(r.decision_date, r.theme): r for r in out.collect()}


def test_leader_and_next_session(spark):
    monday = START + timedelta(weeks=79, days=3)
    rows = lane(spark, growth_panel(extra=[(monday, "__market__", "SPY", 150.0)]))
    last = max(d for d, _ in rows if d <= (START + timedelta(weeks=79)).date())
    top = rows[last, "Leader"]
    assert top.status == "current_leader" and top.leader_rank == 1.0 and top.m0_26w_spy_relative > 0
    assert top.effective_date == monday and top.effective_is_next_session and top.decision_weekday == "Friday"
    assert rows[last, "Laggard"].status in ("not_leader", "warning") and "negative_m0" in rows[last, "Laggard"].warnings


def test_no_lookahead(spark):
    base = growth_panel(70)
    later = [(START + timedelta(weeks=70 + i), t, s, 500 * 1.2**i) for t, s in RATES for i in range(10)]
    a, b = lane(spark, base), lane(spark, base + later)
    # the very last week's next session lies after it, all else is known by then
    names = [c for c in next(iter(a.values())).asDict() if c not in ("effective_date",)]
    assert all([b[k][n] for n in names] == [a[k][n] for n in names] for k in a)


def test_late_member_does_not_dilute_participation(spark):
    entry = START + timedelta(weeks=59)
    late = [(entry + timedelta(weeks=i), "Leader", "L9", 100.0 + i) for i in range(10)]
    rows = lane(spark, growth_panel(70, extra=late))
    before = [r.participation for (d, t), r in rows.items() if t == "Leader" and START.date() < d < entry.date()]
    assert set(before) == {1.0}
    assert rows[entry.date(), "Leader"].participation == 0.75


def test_concentrated_rally_is_watched_and_warned(spark):
    rows = [(START + timedelta(weeks=i), "Narrow", f"N{k}", 100 * (1.25 ** max(i - 64, 0) if k == 0 else 1.0)) for i in range(70) for k in range(4)]
    rows += [(START + timedelta(weeks=i), "Flat", "F0", 100.0) for i in range(70)] + [(START + timedelta(weeks=i), "__market__", "SPY", 100.0) for i in range(70)]
    found = lane(spark, rows, lanes.emerging_radar, EmergingRadarConfig(min_rank_improvement=0.0, score_threshold=0.3))
    last = found[max(d for d, _ in found), "Narrow"]
    assert last.status == "watch" and "concentrated_rally" in last.warnings and last.not_a_buy_recommendation


def test_short_history_and_missing_benchmark(spark):
    assert {r.status for r in lane(spark, growth_panel(30)).values()} == {"insufficient_history"}
    rows = lane(spark, [r for r in growth_panel(60) if r[2] != "spy"])
    assert all(r.m0_26w_spy_relative is None and "missing_spy_26w_baseline" in r.warnings for r in rows.values())


def test_benchmark_name_and_gate(spark):
    rows = lane(spark, growth_panel(), config=CurrentLeaderConfig(benchmark_security=" spy ", min_relative_strength=0.9))
    assert all(not r.m0_baseline_pass for r in rows.values()) and any(r.m0_26w_spy_relative is not None for r in rows.values())


def test_input_rules(spark):
    rows = normalised(spark.createDataFrame([("2024-01-05", " a ", " x ", "1.5"), ("2024-01-06", "a", "x", "bad"), (None, "a", "x", "1"), ("2024-01-06", " ", "x", "1"), ("2024-01-06", "a", "x", "NaN")], "date string, theme string, security string, value string"))
    got = sorted((str(r.week), r.theme, r.security, r.value) for r in rows.collect() if r.value) + [r.value for r in rows.collect() if r.value is None]
    assert got == [("2024-01-05", "a", "X", 1.5), None, None]
    with pytest.raises(ValueError, match="missing columns"):
        normalised(spark.createDataFrame([(1,)], "date int"))
    empty = frame(spark, [])
    assert lanes.current_leader(metrics.theme_metrics(Panel(empty))).collect() == []


def oracle(df, benchmark="SPY"):
    """Weekly metrics with pandas, from the definitions."""
    df = df.assign(security=df.security.str.upper())
    df["week"] = df.date.dt.normalize() + pd.to_timedelta((4 - df.date.dt.weekday) % 7, unit="D")
    grid = pd.date_range(df.week.min(), df.week.max(), freq="W-FRI")
    good = df[df.value > 0].sort_values(["date", "value"], kind="stable")
    px = good.groupby(["theme", "security", "week"]).value.last()
    names = sorted({(t, s) for t, s in zip(df.theme, df.security, strict=True) if s != benchmark})
    prices = pd.DataFrame({k: px.get(k, pd.Series(dtype=float)).reindex(grid) if k in px.index.droplevel(2) else pd.Series(np.nan, grid) for k in names})
    bench = px[px.index.get_level_values(1) == benchmark].groupby(level=2).median().reindex(grid)
    ret, b_ret = prices / prices.shift(1) - 1, bench / bench.shift(1) - 1
    roll = lambda x, w: (1 + x).rolling(w, min_periods=w).apply(np.prod, raw=True) - 1
    seen = prices.notna().cummax()
    out = []
    for theme in sorted({t for t, _ in names}):
        cols = [k for k in names if k[0] == theme]
        r, known = ret[cols], seen[cols].sum(axis=1)
        mean = r.mean(axis=1).where(r.notna().sum(axis=1) >= np.maximum(1, np.ceil(known * 0.5)))
        one = pd.DataFrame({"theme": theme, "participation": r.notna().sum(axis=1) / known.replace(0, np.nan), "theme_return": mean}, grid)
        for w in (4, 13):
            sec, b = roll(ret[cols], w), roll(b_ret, w)
            ok = sec.notna() & b.notna().to_numpy()[:, None]
            one[f"rs_{w}w"] = roll(mean, w) - b
            one[f"breadth_{w}w"] = (sec.gt(b, axis=0) & ok).sum(axis=1) / ok.sum(axis=1).replace(0, np.nan)
            gain = sec.clip(lower=0)
            share = gain.div(gain.sum(axis=1).replace(0, np.nan), axis=0)
            hhi = (share**2).sum(axis=1).where(sec.notna().any(axis=1))
            one[f"concentration_{w}w"] = hhi
        index = ((1 + mean).cumprod() * 100).where(mean.notna())
        one["max_drawdown_52w"] = index.rolling(52, min_periods=52).apply(lambda v: (v / np.maximum.accumulate(v) - 1).min(), raw=True)
        one["annualized_volatility_26w"] = mean.rolling(26, min_periods=26).std() * np.sqrt(52)
        out.append(one.rename_axis("week").reset_index())
    out = pd.concat(out)
    out["rs_rank_4w"] = out.groupby("week").rs_4w.rank(pct=True)
    return out.sort_values(["theme", "week"]).reset_index(drop=True)


def random_panel(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(5):
        for s in range(rng.integers(1, 5)):
            price, begin = 100.0, int(rng.integers(0, 40))
            for i in range(begin, 90):
                price *= 1 + rng.choice([-0.04, 0.0, 0.01, 0.05])
                if rng.random() < 0.04:
                    continue
                for _ in range(rng.choice([1, 1, 2])):
                    rows.append((START + timedelta(weeks=i, days=-int(rng.integers(0, 5)), hours=int(rng.integers(0, 20))), f"T{t}", f"s{s}", float(price * rng.choice([1, 1, 1, 1.01, -1 if rng.random() < 0.05 else 1]))))
    for i in range(90):
        for market in ("__market__", "other"):
            rows.append((START + timedelta(weeks=i, days=-1), market, "SPY", 100 * 1.002**i * (1.01 if market == "other" else 1)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_match_pandas(spark, seed):
    rows = random_panel(seed)
    want = oracle(pd.DataFrame(rows, columns=["date", "theme", "security", "value"]))
    got = metrics.theme_metrics(Panel(frame(spark, rows))).toPandas().sort_values(["theme", "week"]).reset_index(drop=True)
    assert len(got) == len(want)
    for name in want.columns.drop(["week", "theme"]):
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-12, err_msg=name)


def test_rows_in_any_order_and_scaled_prices(spark):
    rows = random_panel(3)
    rng = np.random.default_rng(0)
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    scaled = [(d, t, s, v * 7 if (t, s) == ("T1", "s0") else v) for d, t, s, v in rows]
    base, other, third = (metrics.theme_metrics(Panel(frame(spark, x))).select("week", "theme", F.round("rs_4w", 9), F.round("rs_rank_13w", 9)).collect() for x in (rows, shuffled, scaled))
    assert sorted(base, key=str) == sorted(other, key=str) == sorted(third, key=str)


def test_pipeline(spark):
    rows = growth_panel(70)
    prices = frame(spark, rows)
    run, shuffled = pipeline.run_signal_pipeline(prices), pipeline.run_signal_pipeline(frame(spark, rows[::-1]))
    mark = run.fingerprint.first()[0]
    assert mark == shuffled.fingerprint.first()[0] and len(mark) == 64
    assert mark != pipeline.run_signal_pipeline(prices, "2024-01-05").fingerprint.first()[0]
    assert {r.lane for r in run.manifest().collect()} == {"current_leader", "emerging_radar", "hold_candidate_12m"}
    cut = date(2024, 3, 29)
    early = pipeline.run_signal_pipeline(frame(spark, [r for r in rows if r[0].date() <= cut])).current_leader.collect()
    assert sorted(pipeline.run_signal_pipeline(prices, str(cut)).current_leader.collect()) == sorted(early)
    late = prices.withColumn("feature_available_at", F.col("date") + F.expr("interval 1 day"))
    with pytest.raises(pipeline.AvailabilityError):
        pipeline.run_signal_pipeline(late)
    pipeline.run_signal_pipeline(prices.withColumn("feature_available_at", F.col("date") + F.expr("interval 23 hours")))


def annual_rows():
    rows = []
    a = 100.0
    for i in range(110):
        day = datetime(2022, 1, 7) + timedelta(weeks=i)
        a *= 0.99 if i < 70 else 1.025
        rows += [(day, "A", "A1", a), (day, "B", "B1", 100 * 1.001**i), (day, "__market__", "SPY", 100 * 1.002**i)]
    return rows


def test_annual_and_early(spark):
    data = frame(spark, annual_rows())
    found = {(r.year, r.theme): r for r in annual.annual_theme_leaders(data).collect()}
    assert found[2023, "A"].rank == 1 and found[2023, "A"].excess_return == pytest.approx(found[2023, "A"].theme_return - found[2023, "A"].benchmark_return)
    assert found[2022, "A"].is_partial_year and found[2022, "A"].period_label == "2022년"
    early = annual.early_rise_signals(data).collect()
    confirmed = [r for r in early if r.early_confirmed]
    assert confirmed and all(r.early_watch and r.status == annual.CONFIRMED and r.theme == "A" for r in confirmed)
    cut = annual.early_rise_signals(data, as_of="2023-09-01").collect()
    full = {(r.decision_date, r.theme): r for r in early}
    assert all(full[r.decision_date, r.theme] == r for r in cut)
    assert annual.annual_theme_leaders(frame(spark, [r for r in annual_rows() if r[2] != "SPY"])).collect() == []
    assert {r.theme for r in annual.annual_leadership_report(data)["latest"].collect()} == {"A", "B"}


def test_settings_are_checked():
    for bad in (dict(leader_count=0), dict(score_weights=(1, 1, 0, 0)), dict(m0_window=7), dict(min_participation=2), dict(min_participation=0.0), dict(min_value=float('inf')), dict(min_value=-1.0), dict(min_breadth=1.5)):
        with pytest.raises(ValueError):
            CurrentLeaderConfig(**bad)

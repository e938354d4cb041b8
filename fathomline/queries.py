"""Queries of the panel operators over the star-schema tables, each with its DuckDB twin.

Doubles are rounded to six digits on both sides, and 0.0 is added so that there's no negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.config import CurrentLeaderConfig, EmergingRadarConfig, HoldCandidateConfig, PanelConfig
from fathomline.functions.expr import WINDOWS
from fathomline.operators import metrics, panel
from fathomline.plans import lanes, pipeline
from fathomline.sources.testdata import events_panel, lineitem_panel

#: Configurations that let noisy prices reach every status.
EASY_LEADER = CurrentLeaderConfig(min_breadth=0.2, min_relative_strength=-1.0, min_score=0.3, leader_count=1)
EASY_RADAR = EmergingRadarConfig(min_acceleration_rank=0.3, min_rank_improvement=0.0, min_fast_breadth=0.1, score_threshold=0.3, min_fast_relative_strength=-0.5)
EASY_HOLD = HoldCandidateConfig(min_relative_strength=-0.2, min_breadth=0.1, min_durability_score=0.3, max_annualized_volatility=3.0, max_drawdown=0.9, min_score=0.2)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


WEEK = "cast({0} as date) + cast((5 - isodow({0}) + 7) % 7 as integer)"


def panel_sql(theme: str = "l_returnflag", participation: float = 0.5, until: str | None = None, m0: int = 26) -> str:
    """Common table expressions: series (up to midnight of `until`), px, cal, members, bench, themes, metrics."""
    limit = f"where date <= timestamp '{until}'" if until else ""
    join = "join part on l_partkey = p_partkey" if theme == "p_brand" else ""
    frame = lambda by, n: f"(partition by {by} order by week rows between {n - 1} preceding and current row)" if by else f"(order by week rows between {n - 1} preceding and current row)"

    def windows(value: str, by: str, out: str) -> str:
        return ", ".join(f"case when count({value}) over {frame(by, w)} = {w} then product(1 + {value}) over {frame(by, w)} - 1 end as {out}{w}" for w in WINDOWS)

    sums = ", ".join(
        f"count(case when r{w} is not null and b{w} is not null then 1 end) as v{w}, count(case when r{w} > b{w} then 1 end) as k{w}, count(r{w}) as n{w}, "
        f"sum(greatest(r{w}, 0)) as g{w}, sum(greatest(r{w}, 0) * greatest(r{w}, 0)) as h{w}, max(greatest(r{w}, 0)) as x{w}"
        for w in WINDOWS
    )
    shares = ", ".join(
        f"k{w} / nullif(v{w}, 0) as breadth_{w}w, case when n{w} = 0 then null when g{w} <= 0 then 0 else h{w} / (g{w} * g{w}) end as concentration_{w}w, "
        f"case when n{w} = 0 then null when g{w} <= 0 then 0 else x{w} / g{w} end as top_share_{w}w"
        for w in WINDOWS
    )
    rank = lambda x, out: f"case when {x} is not null then (rank() over (partition by week order by {x} asc nulls last) + (count({x}) over (partition by week, {x}) - 1) / 2.0) / count({x}) over (partition by week) end as {out}"
    return f"""
    lines as (select l_shipdate as date, {WEEK.format('l_shipdate')} as week, {theme} as theme, cast(l_linenumber as varchar) as security, l_extendedprice / l_quantity as unit from lineitem {join}),
    each as (select week, theme, security, max(date) as date, sum(unit) as total, count(unit) as n from lines group by all),
    series as (select * from (select date, week, theme, security, 100 + total / n / 1000 as value from each union all select max(date), week, '__market__', 'SPY', 100 + sum(total) / sum(n) / 1000 from each group by week) {limit}),
    px as (select week, theme, security, max_by(value, date) as price from series where value > 0 group by all),
    cal as (select cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week from series),
    grid as (select week, theme, security from (select distinct theme, security from series where security <> 'SPY'), cal),
    priced as (select week, theme, security, price from grid left join px using (week, theme, security)),
    ret as (select *, max(price is not null) over (partition by theme, security order by week) as seen, price / lag(price) over (partition by theme, security order by week) - 1 as ret from priced),
    members as (select *, {windows('ret', 'theme, security', 'r')} from ret),
    spy as (select week, b_price, b_price / lag(b_price) over (order by week) - 1 as b_ret from cal left join (select week, median(price) as b_price from px where security = 'SPY' group by week) using (week)),
    bench as (select *, {windows('b_ret', '', 'b')} from spy),
    sums as (select week, theme, sum(cast(seen as integer)) as members_seen, count(ret) as members_valid, avg(ret) as mean, {sums} from members left join bench using (week) group by week, theme),
    shares as (select week, theme, members_seen, members_valid, members_valid / nullif(members_seen, 0) as participation,
        case when members_valid >= greatest(1, ceil(members_seen * {participation}::double)) then mean end as theme_return, {shares} from sums),
    themes as (select *, {windows('theme_return', 'theme', 't')}, case when theme_return is not null then 100 * product(1 + theme_return) over (partition by theme order by week) end as theme_index,
        cast(count(theme_return) over (partition by theme order by week) as double) as history_weeks,
        case when count(theme_return) over {frame('theme', 26)} = 26 then stddev_samp(theme_return) over {frame('theme', 26)} * sqrt(52) end as annualized_volatility_26w from shares),
    fall as (select week, theme, min(case when n = 52 then fall end) as max_drawdown_52w from (select b.week, b.theme, a.theme_index / max(a.theme_index) over (partition by b.theme, b.week order by a.week) - 1 as fall, count(a.theme_index) over (partition by b.theme, b.week) as n
        from themes a join themes b on a.theme = b.theme and a.week between b.week - 357 and b.week) group by week, theme),
    ses as (select week, coalesce(min(session) over (order by week rows between current row and unbounded following), cast(week + 3 as timestamp)) as effective_date
        from cal left join (select case when date > cast(week as timestamp) then week else week - 7 end as week, min(date) as session from series group by 1) using (week)),
    strength as (select *, {', '.join(f't{w} - b{w} as rs_{w}w' for w in WINDOWS)} from themes left join bench using (week) left join fall using (week, theme) left join ses using (week)),
    speed as (select *, rs_4w / 4 - rs_8w / 8 as accel_4v8, rs_8w / 8 - rs_13w / 13 as accel_8v13, rs_4w / 4 - rs_13w / 13 as early_acceleration, 0.60::double * (rs_4w / 4 - rs_8w / 8) + 0.40::double * (rs_8w / 8 - rs_13w / 13) as acceleration from strength),
    metrics as (select *, rs_{m0}w as m0, b{m0} as m0_benchmark, {', '.join(rank(f'rs_{w}w', f'rs_rank_{w}w') for w in WINDOWS)}, {rank(f'rs_{m0}w', 'm0_rank')}, {rank('acceleration', 'acceleration_rank')}, {rank('early_acceleration', 'early_acceleration_rank')} from speed)"""


def _panel(spark: SparkSession, sf_dir: str, theme: str = "l_returnflag", config: PanelConfig | None = None) -> panel.Panel:
    return panel.Panel(lineitem_panel(spark, sf_dir, theme), config or PanelConfig())


def _metrics(spark: SparkSession, sf_dir: str, theme: str = "l_returnflag") -> DataFrame:
    return metrics.theme_metrics(_panel(spark, sf_dir, theme))


def with_panel(select: str, theme: str = "l_returnflag", **options) -> str:
    return f"with {panel_sql(theme, **options)} {select}"


@query("m0_rank", with_panel(f"select week, theme, {r6('m0', 'm0_rank')}, coalesce(m0 > 0, false) as is_positive from metrics"))
def m0_rank(spark, sf_dir):
    return metrics.relative_strength(_panel(spark, sf_dir))


@query("m0_rank_brands", with_panel(f"select week, theme, {r6('m0', 'm0_rank')}, coalesce(m0 > 0, false) as is_positive from metrics", "p_brand"))
def m0_rank_brands(spark, sf_dir):
    return metrics.relative_strength(_panel(spark, sf_dir, "p_brand"))


@query("weekly_last", f"select {WEEK.format('ts')} as week, event_type as theme, upper(cast(user_id as varchar)) as security, round(max_by(value, (ts, event_id, value)), 6) + 0.0 as price from events where value > 0 group by all")
def weekly_last(spark, sf_dir):
    return panel.last_of_week(panel.normalised(events_panel(spark, sf_dir), "event_id"))


@query("benchmark_median", with_panel(f"select week, {r6('b_price', 'b_ret')} from bench"))
def benchmark_median(spark, sf_dir):
    return _panel(spark, sf_dir).benchmark.select("week", "b_price", "b_ret")


@query("densify", with_panel(f"select week, theme, security, {r6('price')} from priced"))
def densify(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return panel.densified(p.observed, "SPY").select("week", "theme", "security", "price")


@query("security_returns", with_panel(f"select week, theme, security, seen, {r6('ret')} from members"))
def security_returns(spark, sf_dir):
    return _panel(spark, sf_dir).members.select("week", "theme", "security", "seen", "ret")


@query("theme_returns", with_panel(f"select week, theme, cast(members_valid as bigint) as members_valid, {r6('theme_return')} from themes"))
def theme_returns(spark, sf_dir):
    return _panel(spark, sf_dir).themes.select("week", "theme", "members_valid", "theme_return")


@query("participation", with_panel(f"select week, theme, cast(members_seen as bigint) as members_seen, {r6('participation')} from themes"))
def participation(spark, sf_dir):
    return _panel(spark, sf_dir).themes.select("week", "theme", "members_seen", "participation")


def _rolling(w: int) -> None:
    @query(f"rolling_compound_{w}", with_panel(f"select week, theme, security, {r6(f'r{w}')} from members"))
    def rolling(spark, sf_dir):
        return _panel(spark, sf_dir).members.select("week", "theme", "security", f"r{w}")


for _w in WINDOWS:
    _rolling(_w)


@query("theme_index", with_panel(f"select week, theme, {r6('theme_index')} from themes"))
def theme_index(spark, sf_dir):
    return _panel(spark, sf_dir).themes.select("week", "theme", "theme_index")


def _wide(prefix: str, name: str, select: list[str]) -> None:
    @query(name, with_panel(f"select week, theme, {r6(*select)} from {prefix}"))
    def wide(spark, sf_dir):
        return _metrics(spark, sf_dir).select("week", "theme", *select)


_wide("themes", "breadth", [f"breadth_{w}w" for w in WINDOWS])
_wide("themes", "concentration", [f"{x}_{w}w" for w in WINDOWS for x in ("concentration", "top_share")])
_wide("themes", "history", ["history_weeks"])
_wide("metrics", "relative_strength", [f"rs_{w}w" for w in WINDOWS])
_wide("metrics", "rank_percentiles", [f"rs_rank_{w}w" for w in WINDOWS])
_wide("metrics", "acceleration", ["accel_4v8", "accel_8v13", "acceleration", "acceleration_rank"])
_wide("metrics", "annual_vol", ["annualized_volatility_26w"])
_wide("metrics", "max_drawdown", ["max_drawdown_52w"])


@query("next_session", with_panel("select week, effective_date from ses"))
def next_session(spark, sf_dir):
    return _panel(spark, sf_dir).sessions


def _gate(name: str, least: str, value: float) -> str:
    return f"coalesce({name} >= {value}::double, false) as {least}"


def _flags(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when coalesce({c}, false) then '{n}' end" for c, n in pairs) + "], lambda x: x is not null), '; ')"


HEAD = "week as decision_date, theme, " + r6("m0").replace(" as m0", " as m0_26w_spy_relative") + ", " + r6("m0_rank") + ", m0 is not null as m0_available, m0_benchmark is not null as benchmark_26w_available"
TAIL = (
    "status, warnings, effective_date, week as signal_date, 'Friday' as decision_weekday, coalesce(effective_date > cast(week as timestamp), false) as effective_is_next_session, "
    + r6("m0_rank").replace(" as m0_rank", " as m0_26w_spy_relative_rank")
    + ", m0 is not null as m0_baseline_available, warnings as warning"
)


def trimmed(until: str | None) -> str:
    """Decision dates later than the as-of day go, after all windows are made."""
    return f"where week <= date '{until}'" if until else ""


def leader_sql(c: CurrentLeaderConfig, until: str | None = None) -> str:
    w = c.score_weights
    own = ["rs_13w", "rs_26w", "rs_52w", "rs_rank_13w", "rs_rank_26w", "rs_rank_52w", "breadth_13w", "breadth_26w", "breadth_52w", "breadth_average", "participation", "history_weeks", "leader_score", "leader_rank"]
    flags = _flags(
        ("status = 'insufficient_history'", "insufficient_history"),
        ("m0_benchmark is null", "missing_spy_26w_baseline"),
        ("not m0_baseline_pass and m0 is not null", "negative_m0_26w_spy_relative"),
        ("not breadth_gate_pass", "breadth_below_threshold"),
        ("not participation_gate_pass", "low_participation"),
        ("status = 'eligible_not_top'", "ranked_below_leader_cut"),
    )
    return with_panel(f"""
    , a as (select *, (breadth_13w + breadth_26w + breadth_52w) / 3 as breadth_average from metrics),
    b as (select *, {w[0]}::double * rs_rank_13w + {w[1]}::double * rs_rank_26w + {w[2]}::double * rs_rank_52w + {w[3]}::double * breadth_average as leader_score,
        history_weeks >= {c.min_history_weeks} and rs_13w is not null and rs_26w is not null and rs_52w is not null as ready, {_gate('m0', 'm0_baseline_pass', c.min_relative_strength)},
        coalesce(breadth_13w >= {c.min_breadth}::double and breadth_26w >= {c.min_breadth}::double and breadth_52w >= {c.min_breadth}::double, false) as breadth_gate_pass, {_gate('participation', 'participation_gate_pass', c.min_participation)} from a),
    g as (select *, ready and m0_baseline_pass and breadth_gate_pass and participation_gate_pass as pass from b),
    r as (select *, cast(rank() over (partition by week order by case when pass then leader_score end desc nulls last) as double) as leader_rank from g),
    l as (select *, pass and coalesce(leader_score >= {c.min_score}::double, false) and leader_rank <= {c.leader_count} as is_current_leader from r),
    s as (select *, case when is_current_leader then 'current_leader' when pass then 'eligible_not_top' when ready and not (participation_gate_pass and breadth_gate_pass) then 'warning'
        when not ready then 'insufficient_history' else 'not_leader' end as status from l),
    f as (select *, {flags} as warnings from s)
    select {HEAD}, {r6(*own)}, m0_baseline_pass, breadth_gate_pass, participation_gate_pass, is_current_leader, {TAIL} from f {trimmed(until)}""".replace("\n    ,", ",", 1), participation=c.min_participation, until=until, m0=c.m0_window)


def radar_sql(c: EmergingRadarConfig, until: str | None = None) -> str:
    own = ["rs_4w", "rs_8w", "rs_13w", "rs_rank_4w", "rs_rank_8w", "rs_rank_13w", "accel_4v8", "accel_8v13", "acceleration", "acceleration_rank", "rank_improvement_4v13", "rank_improvement_4v8", "breadth_4w", "breadth_8w", "breadth_13w"]
    own += ["breadth_average", "participation", "concentration_4w", "concentration_8w", "concentration_13w", "concentration_max", "top_security_share_4w", "history_weeks", "radar_score"]
    gates = ["m0_baseline_pass", "acceleration_gate_pass", "rank_improvement_gate_pass", "breadth_gate_pass", "participation_gate_pass", "concentration_gate_pass"]
    flags = _flags(
        ("true", "watchlist_only_not_a_buy_recommendation"),
        ("status = 'insufficient_history'", "insufficient_history"),
        ("m0_benchmark is null", "missing_spy_26w_baseline"),
        ("m0 is not null and not m0_baseline_pass", "negative_m0_26w_spy_relative"),
        ("breadth_4w is not null and not breadth_gate_pass", "low_breadth"),
        ("participation is not null and not participation_gate_pass", "low_participation"),
        ("concentration_max is not null and not concentration_gate_pass", "concentrated_rally"),
        ("rank_improvement_4v13 is not null and not rank_improvement_gate_pass", "rank_not_improving"),
    )
    return with_panel(f"""
    , a as (select *, rs_rank_4w - rs_rank_13w as rank_improvement_4v13, rs_rank_4w - rs_rank_8w as rank_improvement_4v8, 0.5::double * breadth_4w + 0.3::double * breadth_8w + 0.2::double * breadth_13w as breadth_average,
        greatest(concentration_4w, concentration_8w, concentration_13w) as concentration_max, top_share_4w as top_security_share_4w from metrics),
    b as (select *, 0.35::double * acceleration_rank + 0.25::double * rs_rank_4w + 0.2::double * (case when rank_improvement_4v13 is not null then least(greatest(rank_improvement_4v13, 0), 1) end) + 0.1::double * breadth_average + 0.1::double * participation as radar_score,
        history_weeks >= {c.min_history_weeks} and rs_4w is not null and acceleration is not null as ready, {_gate('m0', gates[0], 0.0)}, {_gate('acceleration_rank', gates[1], c.min_acceleration_rank)}, {_gate('rank_improvement_4v13', gates[2], c.min_rank_improvement)},
        {_gate('breadth_4w', gates[3], c.min_fast_breadth)}, {_gate('participation', gates[4], c.min_participation_for_watch)}, coalesce(concentration_max <= {c.max_concentration}::double, false) as concentration_gate_pass from a),
    l as (select *, ready and participation_gate_pass and rank_improvement_gate_pass and acceleration_gate_pass and coalesce(rs_4w >= {c.min_fast_relative_strength}::double, false) and coalesce(radar_score >= {c.score_threshold}::double, false) as is_watchlist from b),
    s as (select *, case when is_watchlist then 'watch' when ready and not (participation_gate_pass and breadth_gate_pass and concentration_gate_pass) then 'warning' when not ready then 'insufficient_history' else 'not_watch' end as status from l),
    f as (select *, {flags} as warnings from s)
    select {HEAD}, {r6(*own)}, {', '.join(gates)}, is_watchlist, {TAIL}, '{lanes.RECOMMENDATION}' as recommendation, true as not_a_buy_recommendation from f {trimmed(until)}""".replace("\n    ,", ",", 1), participation=c.min_participation, until=until, m0=c.m0_window)


def hold_sql(c: HoldCandidateConfig, until: str | None = None) -> str:
    own = ["rs_13w", "rs_26w", "rs_52w", "rs_rank_13w", "rs_rank_26w", "rs_rank_52w", "breadth_13w", "breadth_26w", "breadth_52w", "breadth_average", "participation", "concentration_13w", "concentration_26w", "concentration_52w", "concentration_max"]
    own += ["annualized_volatility_26w", "max_drawdown_52w", "durability_score", "confirmation_count", "candidate_score", "history_weeks"]
    gates = ["m0_baseline_pass", "rs_gate_pass", "durability_gate_pass", "risk_gate_pass", "confirmation_gate_pass"]
    least = lambda names, v: " and ".join(f"{n} >= {v}::double" for n in names)
    rs, br = [f"rs_{n}w" for n in (13, 26, 52)], [f"breadth_{n}w" for n in (13, 26, 52)]
    over = f"over (partition by theme order by week rows between {c.confirmation_window - 1} preceding and current row)"
    flags = _flags(
        ("status = 'insufficient_history'", "insufficient_history"),
        ("m0_benchmark is null", "missing_spy_26w_baseline"),
        ("m0 is not null and not m0_baseline_pass", "negative_m0_26w_spy_relative"),
        ("rs_13w is not null and not rs_gate_pass", "relative_strength_gate_failed"),
        ("durability_score is not null and not durability_gate_pass", "durability_gate_failed"),
        (f"not risk_gate_pass and concentration_max > {c.max_concentration}::double", "concentrated_rally"),
        (f"concentration_max is not null and not risk_gate_pass and annualized_volatility_26w > {c.max_annualized_volatility}::double", "high_volatility"),
        (f"concentration_max is not null and not risk_gate_pass and max_drawdown_52w < {-c.max_drawdown}::double", "deep_drawdown"),
        ("status = 'awaiting_confirmation'", "awaiting_confirmation"),
    )
    return with_panel(f"""
    , a as (select *, (breadth_13w + breadth_26w + breadth_52w) / 3 as breadth_average, greatest(concentration_13w, concentration_26w, concentration_52w) as concentration_max,
        0.3::double * breadth_13w + 0.35::double * breadth_26w + 0.2::double * breadth_52w + 0.15::double * participation as durability_score, {_gate('m0', gates[0], c.min_relative_strength)}, coalesce({least(rs, c.min_relative_strength)}, false) as rs_gate_pass from metrics),
    b as (select *, coalesce({least(br, c.min_breadth)} and participation >= {c.min_participation}::double and durability_score >= {c.min_durability_score}::double, false) as durability_gate_pass,
        coalesce(concentration_max <= {c.max_concentration}::double and annualized_volatility_26w <= {c.max_annualized_volatility}::double and max_drawdown_52w >= {-c.max_drawdown}::double, false) as risk_gate_pass from a),
    k as (select *, case when count(*) {over} = {c.confirmation_window} then sum(cast(rs_gate_pass and m0_baseline_pass and durability_gate_pass as double)) {over} end as confirmation_count from b),
    d as (select *, 0.35::double * (rs_rank_13w + rs_rank_26w + rs_rank_52w) / 3 + 0.35::double * durability_score + 0.15::double * (1 - case when annualized_volatility_26w is not null then least(annualized_volatility_26w / {c.max_annualized_volatility}::double, 1) end)
        + 0.15::double * (1 + case when max_drawdown_52w is not null then least(greatest(max_drawdown_52w / {c.max_drawdown}::double, -1), 0) end) as candidate_score, coalesce(confirmation_count >= {c.min_confirmed_weeks}, false) as confirmation_gate_pass,
        history_weeks >= {c.min_history_weeks} and rs_13w is not null and rs_26w is not null and rs_52w is not null and breadth_average is not null and annualized_volatility_26w is not null and max_drawdown_52w is not null as ready,
        rs_gate_pass and m0_baseline_pass as strong from k),
    l as (select *, ready and strong and durability_gate_pass and risk_gate_pass and confirmation_gate_pass and coalesce(candidate_score >= {c.min_score}::double, false) as is_hold_candidate from d),
    s as (select *, case when is_hold_candidate then 'hold_candidate' when ready and strong and durability_gate_pass and risk_gate_pass and not confirmation_gate_pass then 'awaiting_confirmation'
        when ready and strong and durability_gate_pass and not risk_gate_pass then 'risk_rejected' when ready and not (strong and durability_gate_pass) then 'warning' when not ready then 'insufficient_history' else 'not_candidate' end as status from l),
    f as (select *, {flags} as warnings from s)
    select {HEAD}, {r6(*own)}, {', '.join(gates)}, is_hold_candidate, {TAIL} from f {trimmed(until)}""".replace("\n    ,", ",", 1), participation=c.min_participation, until=until, m0=c.m0_window)


def _lane(name: str, lane, config, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return lane(metrics.theme_metrics(_panel(spark, sf_dir, config=config)), config)


_lane("current_leader", lanes.current_leader, CurrentLeaderConfig(), leader_sql(CurrentLeaderConfig()))
_lane("current_leader_easy", lanes.current_leader, EASY_LEADER, leader_sql(EASY_LEADER))
_lane("emerging_radar", lanes.emerging_radar, EmergingRadarConfig(), radar_sql(EmergingRadarConfig()))
_lane("emerging_radar_easy", lanes.emerging_radar, EASY_RADAR, radar_sql(EASY_RADAR))
_lane("hold_candidate", lanes.hold_candidate_12m, HoldCandidateConfig(), hold_sql(HoldCandidateConfig()))
_lane("hold_candidate_easy", lanes.hold_candidate_12m, EASY_HOLD, hold_sql(EASY_HOLD))


#: A Wednesday: the week that it lies in has no decision yet.
AS_OF = "1999-03-10"
#: Settings of which each lane needs a panel of its own.
OWN_LEADER = CurrentLeaderConfig(**{**EASY_LEADER.__dict__, "m0_window": 13, "min_participation": 0.4})
OWN_RADAR = EmergingRadarConfig(**{**EASY_RADAR.__dict__, "min_participation": 0.9})
OWN_HOLD = HoldCandidateConfig(**{**EASY_HOLD.__dict__, "min_participation": 0.75})


def _as_of(name: str, lane: str, sql) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return pipeline.run_signal_pipeline(lineitem_panel(spark, sf_dir), AS_OF, OWN_LEADER, OWN_RADAR, OWN_HOLD).lanes[lane]


_as_of("current_leader_as_of", "current_leader", leader_sql(OWN_LEADER, AS_OF))
_as_of("emerging_radar_as_of", "emerging_radar", radar_sql(OWN_RADAR, AS_OF))
_as_of("hold_candidate_as_of", "hold_candidate_12m", hold_sql(OWN_HOLD, AS_OF))


@query("m0_rank_13", with_panel(f"select week, theme, {r6('m0', 'm0_rank')}, coalesce(m0 > 0, false) as is_positive from metrics", m0=13))
def m0_rank_13(spark, sf_dir):
    return metrics.relative_strength(_panel(spark, sf_dir, config=PanelConfig(m0_window=13)))

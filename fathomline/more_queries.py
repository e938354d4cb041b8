"""Queries of annual tables, labels, episodes, rank metrics, audits, splits, memberships and scorecards, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.config import AnnualConfig, Clock, EarlyHitConfig, EpisodeConfig, SplitConfig
from fathomline.operators import audits, early_hits, episodes, labels, membership, rank_metrics, scorecard, splits
from fathomline.operators.metrics import theme_metrics
from fathomline.plans import annual, lanes, pipeline
from fathomline.queries import EASY_HOLD, EASY_LEADER, EASY_RADAR, _metrics, _panel, query, r6, with_panel
from fathomline.sources.readers import unpivoted
from fathomline.sources.shared import written
from fathomline.sources.testdata import lineitem_panel, table

EASY_ANNUAL = AnnualConfig(min_coverage=0.3, min_weeks_per_year=10, top_n=2, early_min_rank=0.3, early_min_acceleration_rank=0.3, early_min_rank_improvement=-1.0, early_min_breadth=0.1, early_min_fast_rs=-0.5)
MOVES = EpisodeConfig(major_return=0.03, major_excess=0.005, explosive_return=0.05, min_breadth=0.2, min_names=1, horizon_weeks=26, onset_weeks=13, merge_gap_weeks=13, min_rank=0.3)
CLOSE = EpisodeConfig(**{**MOVES.__dict__, "horizon_weeks": 8, "onset_weeks": 5, "major_return": 0.02})
TODAY = Clock(date(2002, 1, 1))


def annual_sql(c: AnnualConfig, until: str | None = None) -> str:
    edges = lambda v, src, by: f"""select {by}, year, min_by(week, week) filter ({v} is not null) as fw, min_by({v}, week) filter ({v} is not null) as fv, max_by(week, week) filter ({v} is not null) as lw, max_by({v}, week) filter ({v} is not null) as lv from {src} group by {by}, year"""
    before = lambda src, by: f"""select *, last_value(lw ignore nulls) over w as bw, last_value(lv ignore nulls) over w as bv from ({src}) window w as (partition by {by} order by year rows between unbounded preceding and 1 preceding)"""
    return with_panel(f"""
    , ty as (select *, year(week) as year from themes), by_ as (select *, year(week) as year, 1 as one from bench),
    cy as (select year, count(*) as weeks, max(week) as last_week, count(b_price) as b_weeks from by_ group by year),
    b as (select year, bw is null as b_partial, case when coalesce(bv, fv) > 0 then lv / coalesce(bv, fv) - 1 end as benchmark_return from ({before(edges('b_price', 'by_', 'one'), 'one')})),
    t as (select theme, year, coalesce(bw, fw) as sd, lw as ed, bw is null as partial, case when coalesce(bv, fv) > 0 then lv / coalesce(bv, fv) - 1 end as theme_return from ({before(edges('theme_index', 'ty', 'theme'), 'theme')})),
    o as (select theme, year, count(theme_return) as observations from ty group by all),
    j as (select *, observations / weeks as cov, b_weeks / weeks as bcov, last_week < make_date(year, 12, 15) as ytd from t join o using (theme, year) join cy using (year) join b using (year)),
    k as (select * from j where benchmark_return is not null and bcov >= {c.min_coverage} and theme_return is not null and observations >= {c.min_weeks_per_year} and cov >= {c.min_coverage}),
    r as (select *, cast(rank() over (partition by year order by theme_return desc) as integer) as rank from k)
    select cast(year as integer) as year, case when ytd then year || '년 누적' else year || '년' end as period_label, theme, {r6('theme_return', 'benchmark_return')}, round(theme_return - benchmark_return, 6) + 0.0 as excess_return, rank,
        round(cov, 4) + 0.0 as coverage, round(bcov, 4) + 0.0 as benchmark_coverage, observations, cast(sd as varchar) as start_date, cast(ed as varchar) as end_date, ytd or partial or b_partial as is_partial_year, 'ok' as status, '{annual.DISCLAIMER}' as disclaimer
    from r where rank <= {c.top_n}""".replace("\n    ,", ",", 1), participation=c.min_participation, until=until)


def early_sql(c: AnnualConfig, select: str) -> str:
    over = f"over (partition by theme order by week rows between {c.confirmation_window_weeks - 1} preceding and current row)"
    return with_panel(f"""
    , w as (select *, rs_rank_4w - rs_rank_13w as rank_improvement_4v13, coalesce(history_weeks >= {c.signal_history_weeks} and rs_4w >= {c.early_min_fast_rs}::double and m0 >= {c.early_min_m0}::double and rs_rank_4w >= {c.early_min_rank}::double
        and early_acceleration_rank >= {c.early_min_acceleration_rank}::double and rs_rank_4w - rs_rank_13w >= {c.early_min_rank_improvement}::double and breadth_4w >= {c.early_min_breadth}::double and participation >= {c.early_min_participation}::double, false) as early_watch from metrics),
    n as (select *, case when count(*) {over} = {c.confirmation_window_weeks} then sum(cast(early_watch as double)) {over} end as confirmation_count from w),
    s as (select *, coalesce(confirmation_count >= {c.confirmation_count}, false) as state from n),
    e as (select *, state and not coalesce(lag(state) over (partition by theme order by week), false) as early_confirmed from s),
    f as (select *, case when history_weeks < {c.signal_history_weeks} then '{annual.TOO_LITTLE}' when early_confirmed then '{annual.CONFIRMED}' when early_watch then '{annual.WATCHED}' else '{annual.UNMET}' end as status from e),
    g as (select week as decision_date, theme, early_watch, early_confirmed, status as signal_type, {r6('rs_4w', 'rs_13w')}, round(m0, 6) + 0.0 as m0_26w_spy_relative, {r6('rs_rank_4w')}, round(early_acceleration_rank, 6) + 0.0 as acceleration_rank,
        {r6('rank_improvement_4v13', 'breadth_4w', 'participation', 'history_weeks', 'confirmation_count')}, status, '{annual.RECOMMENDATION}' as recommendation, '{annual.DISCLAIMER}' as disclaimer from f) {select}""".replace("\n    ,", ",", 1))


def _annual(name: str, c: AnnualConfig) -> None:
    @query(f"annual_leaders{name}", annual_sql(c))
    def leaders(spark, sf_dir):
        return annual.annual_theme_leaders(lineitem_panel(spark, sf_dir), c)

    @query(f"early_rise{name}", early_sql(c, "select * from g"))
    def early(spark, sf_dir):
        return annual.early_rise_signals(lineitem_panel(spark, sf_dir), c)


_annual("", AnnualConfig())
_annual("_easy", EASY_ANNUAL)


@query("latest_early", early_sql(AnnualConfig(), "select * from g qualify row_number() over (partition by theme order by decision_date desc) = 1"))
def latest_early(spark, sf_dir):
    return annual.annual_leadership_report(lineitem_panel(spark, sf_dir))["latest"]


def lane_sql(name: str) -> str:
    from fathomline.queries import SQL

    return SQL[name]


@query("latest_cross_section", f"select decision_date, theme, status from ({lane_sql('current_leader_easy')}) qualify decision_date = max(decision_date) over ()")
def latest_cross_section(spark, sf_dir):
    return pipeline.latest_cross_section(lanes.current_leader(_metrics(spark, sf_dir), EASY_LEADER)).select("decision_date", "theme", "status")


@query(
    "lane_status_counts",
    " union all ".join(
        f"select '{lane}' as lane, status, count(*) as rows, decision_date as latest_date, sum(count(*)) over ()::bigint as lane_rows from (select * from ({lane_sql(q)}) where decision_date <= (select max(l_shipdate) from lineitem) qualify decision_date = max(decision_date) over ()) group by status, decision_date"
        for lane, q in (("current_leader", "current_leader_easy"), ("emerging_radar", "emerging_radar_easy"), ("hold_candidate_12m", "hold_candidate_easy"))
    ),
)
def lane_status_counts(spark, sf_dir):
    return pipeline.run_signal_pipeline(lineitem_panel(spark, sf_dir), None, EASY_LEADER, EASY_RADAR, EASY_HOLD, keep=written).manifest()


@query("fingerprint", "select true as same_in_any_order, true as other_for_another_row, true as other_for_a_missing_row, true as other_for_other_settings, 64 as digits")
def fingerprint(spark, sf_dir):
    """What a fingerprint has to tell apart: all rows against the same rows in another order, one row changed, one row left out, and other settings."""
    prices = lineitem_panel(spark, sf_dir)
    at = prices.agg(F.max(F.struct("date", "theme", "security"))).first()[0]
    last = (F.col("date") == F.lit(at["date"])) & (F.col("theme") == at["theme"]) & (F.col("security") == at["security"])
    kinds = {
        "own": (prices, "settings"),
        "shuffled": (prices.repartition(7, F.xxhash64("value")).sortWithinPartitions(F.desc("value")), "settings"),
        "changed": (prices.withColumn("value", F.when(last, F.col("value") + 0.01).otherwise(F.col("value"))), "settings"),
        "shorter": (prices.where(~last), "settings"),
        "settings": (prices, "others"),
    }
    marks = None
    for name, (rows, settings) in kinds.items():
        mark = pipeline.fingerprint(rows, settings).withColumnRenamed("fingerprint", name)
        marks = mark if marks is None else marks.join(F.broadcast(mark), F.lit(True))
    same = lambda n: F.col("own") == F.col(n)
    return marks.select(same("shuffled").alias("same_in_any_order"), (~same("changed")).alias("other_for_another_row"), (~same("shorter")).alias("other_for_a_missing_row"), (~same("settings")).alias("other_for_other_settings"), F.length("own").alias("digits"))


# --- labels and episodes over the theme indexes ---


def index_series(spark, sf_dir) -> DataFrame:
    p = _panel(spark, sf_dir)
    return p.themes.join(F.broadcast(p.benchmark), "week").select("theme", F.col("week").cast("timestamp_ntz").alias("ts"), F.col("theme_index").alias("price"), F.col("b_price"))


SERIES = ", s as (select theme, cast(week as timestamp) as ts, theme_index as price, b_price, row_number() over (partition by theme order by week) - 1 as pos from themes join bench using (week) where theme_index is not null and b_price is not null)"


def forward_sql(horizons) -> str:
    exits = ", ".join(f"first_value({{'ts': ts, 'price': price, 'b_price': b_price, 'pos': pos}}) over (partition by theme order by ts range between interval {7 * h} days following and unbounded following) as x{h}" for h in horizons)
    leads = ", ".join(f"lead(x{h}) over (partition by theme order by ts) as exit_{h}" for h in horizons)
    return f"{SERIES}, x as (select *, {{'ts': ts, 'price': price, 'b_price': b_price, 'pos': pos}} as here, {exits} from s), y as (select theme, ts, lead(here) over (partition by theme order by ts) as entry, {leads} from x)"


def gains_sql(h: int, alias: str = "y") -> str:
    done = f"exit_{h} is not null and entry.price <> 0"
    return f"case when {done} then exit_{h}.price / entry.price - 1 end as g{h}, case when {done} and entry.b_price <> 0 then exit_{h}.b_price / entry.b_price - 1 end as b{h}"


def _label_columns(horizons, drawdown: bool = False) -> list[str]:
    out = ["decision_at", "theme"]
    for h in horizons:
        out += [f"entry_at_{h}w", f"exit_at_{h}w", f"future_{h}w_return", f"future_{h}w_benchmark_return", f"future_{h}w_excess_return", f"label_{h}w"]
    return out


def labels_sql(horizons, absolute: float, excess: float) -> str:
    columns = ", ".join(
        f"entry.ts as entry_at_{h}w, exit_{h}.ts as exit_at_{h}w, round(g{h}, 6) + 0.0 as future_{h}w_return, round(b{h}, 6) + 0.0 as future_{h}w_benchmark_return, round(g{h} - b{h}, 6) + 0.0 as future_{h}w_excess_return, "
        f"case when g{h} is not null and b{h} is not null then g{h} >= {absolute}::double and g{h} - b{h} >= {excess}::double end as label_{h}w"
        for h in horizons
    )
    return with_panel(f"{forward_sql(horizons)}, z as (select *, {', '.join(gains_sql(h) for h in horizons)} from y) select ts as decision_at, theme, {columns} from z".lstrip())


@query("future_labels", labels_sql(labels.HORIZONS, 0.01, 0.005))
def future_labels(spark, sf_dir):
    return labels.future_labels(index_series(spark, sf_dir), absolute_threshold=0.01, excess_threshold=0.005).select(*_label_columns(labels.HORIZONS))


@query(
    "future_drawdown",
    with_panel(
        f"{forward_sql((26,))}, p as (select y.theme, y.ts, s.pos, s.price / max(s.price) over (partition by y.theme, y.ts order by s.pos) - 1 as fall from y join s on s.theme = y.theme and s.pos between y.entry.pos and y.exit_26.pos) "
        "select y.ts as decision_at, y.theme, round(min(fall), 6) + 0.0 as future_26w_max_relative_drawdown from y left join p on p.theme = y.theme and p.ts = y.ts group by y.ts, y.theme"
    ),
)
def future_drawdown(spark, sf_dir):
    return labels.future_labels(index_series(spark, sf_dir), (26,)).select("decision_at", "theme", "future_26w_max_relative_drawdown")


@query(
    "future_panel_leader",
    with_panel(
        f"{forward_sql((13, 26))}, z as (select *, {gains_sql(13)}, {gains_sql(26)} from y), k as (select *, "
        + ", ".join(f"case when g{h} is not null then (rank() over (partition by ts order by g{h} asc nulls last) + (count(g{h}) over (partition by ts, g{h}) - 1) / 2.0) / count(g{h}) over (partition by ts) end as k{h}" for h in (13, 26))
        + " from z) select ts as decision_at, theme, "
        + ", ".join(f"round(k{h}, 6) + 0.0 as future_{h}w_return_rank, coalesce(g{h} - b{h} > 0 and k{h} >= 0.8::double, false) as leader_{h}w" for h in (13, 26))
        + " from k"
    ),
)
def future_panel_leader(spark, sf_dir):
    return labels.future_panel_labels(index_series(spark, sf_dir), (13, 26)).select("decision_at", "theme", *(f"{n}" for h in (13, 26) for n in (f"future_{h}w_return_rank", f"leader_{h}w")))


def move_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 15).alias("theme_return"),
        (F.col("l_tax") * 5).alias("spy_return"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 50.0).alias("breadth_up"),
        F.when(F.col("l_linenumber") > 2, F.col("l_discount") * 10).alias("breadth_beat_spy"),
        F.col("l_linenumber").cast("bigint").alias("active_names"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 50.0).alias("theme_rank_percentile"),
    )


@query(
    "classify_episode",
    """with m as (select l_orderkey, l_linenumber, l_discount * 15 as t, l_tax * 5 as s, case when l_linenumber <> 3 then l_quantity / 50 end as up, case when l_linenumber > 2 then l_discount * 10 end as beat, l_linenumber as names, case when l_returnflag = 'A' then l_quantity / 50 end as rk from lineitem),
    g as (select *, coalesce(up >= 0.6::double, false) and coalesce(beat >= 0.5::double, true) as breadth_ok, names >= 4 as min_names_ok, coalesce(rk >= 0.9::double, true) as top_decile_ok from m),
    k as (select *, t >= 0.8::double and t - s >= 0.4::double and breadth_ok and min_names_ok and top_decile_ok as major_surge from g)
    select l_orderkey, l_linenumber, round(t - s, 6) + 0.0 as excess_return, breadth_ok, min_names_ok, top_decile_ok, major_surge, major_surge and t >= 1.0::double as explosive, case when major_surge and t >= 1.0::double then 'explosive' when major_surge then 'major_surge' else 'none' end as label from k""",
)
def classify_episode(spark, sf_dir):
    return labels.classify_moves(move_table(spark, sf_dir)).select("l_orderkey", "l_linenumber", "excess_return", "breadth_ok", "min_names_ok", "top_decile_ok", "major_surge", "explosive", "label")


def series_of(found: DataFrame) -> DataFrame:
    return found.select("theme", F.col("week").cast("timestamp_ntz").alias("ts"), F.col("theme_index").alias("price"), "b_price")


def episode_facts(found: DataFrame) -> DataFrame:
    return found.select("theme", F.col("week").cast("timestamp_ntz").alias("decision_at"), F.col("breadth_13w").alias("breadth_up"), F.col("members_valid").alias("active_names"), F.col("m0_rank").alias("theme_rank_percentile"))


def episode_table(spark, sf_dir, c: EpisodeConfig = MOVES, found: DataFrame | None = None) -> DataFrame:
    """Series and facts are columns of one metrics table, which is written once."""
    found = found if found is not None else written(theme_metrics(_panel(spark, sf_dir)), "metrics")
    return episodes.label_episodes(series_of(found), episode_facts(found), c)


def episode_sql(c: EpisodeConfig) -> str:
    """Common table expressions up to `el`, the label of each decision, and `ep`, the episodes. Searches are joins over all later rows of a theme."""
    h = 7 * c.horizon_weeks
    gates = ["breadth_up_ok", "breadth_beat_spy_ok", "breadth_ok", "min_names_ok", "top_decile_ok"]
    return f"""{SERIES},
    until as (select r.theme, r.pos, min(q.pos) as until from s r join s q on q.theme = r.theme and q.ts >= r.ts + interval {h} days group by all),
    lows as (select r.theme, r.pos, min_by(q.pos, (q.price, q.pos)) as low_pos, min(q.price) as low from s r join s q on q.theme = r.theme and q.pos between r.pos - {c.onset_weeks} and r.pos group by all),
    crossings as (select theme, pos, low_pos from lows join s using (theme, pos) where low > 0 and price / low - 1 >= {c.major_return}::double),
    span as (select d.theme, d.pos, d.pos + 1 as entry, u.until as terminal, min(x.pos) as crossing from s d join until u on u.theme = d.theme and u.pos = d.pos + 1 left join crossings x on x.theme = d.theme and x.pos between d.pos + 1 and u.until group by all),
    reach as (select span.*, x.low_pos, coalesce(crossing, entry) as first_row, case when crossing is not null then coalesce(u.until, terminal) else terminal end as last_row
        from span left join crossings x on x.theme = span.theme and x.pos = span.crossing left join until u on u.theme = span.theme and u.pos = span.crossing),
    peaks as (select r.theme, r.pos, min_by(q.pos, (-q.price, q.pos)) as peak from reach r join s q on q.theme = r.theme and q.pos between r.first_row and r.last_row group by all),
    moves as (select d.theme, d.ts as decision_at, e.ts as entry_at, o.ts as onset, x.ts as first_80_crossing, p.ts as peak, t.ts as horizon_end, p.price / e.price - 1 as entry_to_peak_return, p.price / o.price - 1 as theme_return,
        p.b_price / o.b_price - 1 as spy_return, r.terminal is not null as matured
        from s d left join s e on e.theme = d.theme and e.pos = d.pos + 1 left join reach r on r.theme = d.theme and r.pos = d.pos left join peaks k on k.theme = d.theme and k.pos = d.pos
        left join s o on o.theme = d.theme and o.pos = coalesce(r.low_pos, r.entry) left join s x on x.theme = d.theme and x.pos = r.crossing left join s p on p.theme = d.theme and p.pos = k.peak left join s t on t.theme = d.theme and t.pos = r.terminal),
    facts as (select theme, cast(week as timestamp) as decision_at, breadth_13w as breadth_up, members_valid as active_names, m0_rank as theme_rank_percentile from metrics),
    graded as (select *, theme_return - spy_return as excess_return, coalesce(breadth_up >= {c.min_breadth}::double, false) as breadth_up_ok, true as breadth_beat_spy_ok, coalesce(breadth_up >= {c.min_breadth}::double, false) as breadth_ok,
        coalesce(active_names >= {c.min_names}, false) as min_names_ok, coalesce(theme_rank_percentile >= {c.min_rank}::double, true) as top_decile_ok from moves left join facts using (theme, decision_at)),
    named as (select *, matured and first_80_crossing is not null and coalesce(theme_return >= {c.major_return}::double and excess_return >= {c.major_excess}::double and breadth_ok and min_names_ok and top_decile_ok, false) as major_surge from graded),
    el as (select decision_at, theme, entry_at, onset, first_80_crossing, peak as "end", peak, peak as label_available_at, horizon_end, {r6('entry_to_peak_return', 'theme_return', 'spy_return', 'excess_return', 'breadth_up')}, cast(active_names as bigint) as active_names, {r6('theme_rank_percentile')},
        {', '.join(f'matured and {g} as {g}' for g in gates)}, case when matured then case when major_surge and theme_return >= {c.explosive_return}::double then 'explosive' when major_surge then 'major_surge' else 'none' end end as label,
        major_surge, major_surge and theme_return >= {c.explosive_return}::double as explosive, major_surge as qualifies, matured from named),
    marks as (select theme, decision_at as start, "end", row_number() over (partition by theme order by decision_at) as n from el where qualifies),
    follows as (select a.theme, a.start, min(b.start) as next from marks a join marks b on b.theme = a.theme and b.start - a.start >= interval {7 * c.merge_gap_weeks} days and b.start > a."end" group by all),
    chain(theme, start, episode_id) as (select theme, start, 1 from marks where n = 1 union all select chain.theme, follows.next, episode_id + 1 from chain join follows on follows.theme = chain.theme and follows.start = chain.start),
    ep as (select el.* exclude (decision_at), chain.start, cast(episode_id as integer) as episode_id from chain join el on el.theme = chain.theme and el.decision_at = chain.start)"""


def with_episodes(select: str, c: EpisodeConfig = MOVES) -> str:
    return with_panel(f"{episode_sql(c).lstrip()} {select}").replace("with ", "with recursive ", 1)


@query("episode_labels", with_episodes("select * from el"))
def episode_labels(spark, sf_dir):
    return episode_table(spark, sf_dir)


@query("detect_episodes", with_episodes("select * from ep"))
def detect_episodes(spark, sf_dir):
    return episodes.detect_episodes(episode_table(spark, sf_dir), MOVES.merge_gap_weeks)


@query("episode_labels_close", with_episodes("select decision_at, theme, label, peak, theme_return from el", CLOSE))
def episode_labels_close(spark, sf_dir):
    """A short horizon: many crossings lie in one block of time, and many in the series' last horizon."""
    return episode_table(spark, sf_dir, CLOSE).select("decision_at", "theme", "label", "peak", "theme_return")


HITS, STRICT_HITS = EarlyHitConfig(horizon_weeks=26), EarlyHitConfig(persistence_window=None, log_fraction=None, weeks_before=8, weeks_after=20)


def early_hit_rows(spark, sf_dir, c: EarlyHitConfig = HITS, known: bool = False) -> DataFrame:
    """known: signals say when their features were known, and late ones don't count."""
    each = written(theme_metrics(_panel(spark, sf_dir)), "metrics")
    found = episodes.detect_episodes(episode_table(spark, sf_dir, found=each), MOVES.merge_gap_weeks)
    signals = each.select("theme", F.col("week").cast("timestamp_ntz").alias("decision_at"), (F.col("rs_rank_4w") > 0.5).alias("signal"))
    if known:
        late = F.make_dt_interval(F.weekofyear("decision_at") % 3 - 1)
        signals = signals.withColumn("feature_available_at", F.when(F.weekofyear("decision_at") % 5 != 0, F.col("decision_at") + late))
    return early_hits.evaluate_early_hits(signals, series_of(each), found.select("theme", "onset", "peak", "qualifies"), c, 0.02, 0.005, require_point_in_time=known)


def early_sql_rows(c: EarlyHitConfig, select: str, known: bool = False) -> str:
    in_time = "week(decision_at) % 5 <> 0 and week(decision_at) % 3 - 1 <= 0" if known else "true"
    horizons = sorted({c.horizon_weeks, 52})
    limit = "true" if c.log_fraction is None else f"made / total < {c.log_fraction}::double"
    h = c.horizon_weeks
    return with_episodes(f"""{forward_sql(horizons).replace(SERIES, '')},
    gains as (select *, {', '.join(gains_sql(n) for n in horizons)} from y),
    signals as (select theme, cast(week as timestamp) as decision_at, coalesce(rs_rank_4w > 0.5::double, false) as signal from metrics),
    lasting as (select *, signal and sum(cast(signal as integer)) over (partition by theme order by decision_at rows between {c.window - 1} preceding and current row) >= {c.persistence_count} as persistent from signals),
    events as (select theme, onset, peak, qualifies, row_number() over (partition by theme order by onset, peak) as o from ep),
    owned as (select l.theme, l.decision_at, max(o) as o from lasting l join events e on e.theme = l.theme and e.onset <= l.decision_at group by all),
    seen as (select l.theme, l.decision_at, max_by(price, ts) as seen from lasting l join s on s.theme = l.theme and s.ts <= l.decision_at group by all),
    ends as (select e.theme, e.o, max_by(s.price, s.ts) filter (s.ts <= e.onset) as base, max_by(s.price, s.ts) filter (s.ts <= e.peak) as top from events e join s on s.theme = e.theme group by all),
    whole as (select l.*, e.onset as event_start, e.peak as event_peak, e.qualifies, base, top, seen, g.entry.ts as entry_at, g.exit_{h}.ts as exit_at, g.g{h} as future_return, g.g{h} - g.b{h} as future_excess_return,
        case when g.g{h} is not null and g.b{h} is not null then g.g{h} >= 0.02::double and g.g{h} - g.b{h} >= 0.005::double end as label, g.g52 as hold_52w_return, g.g52 - g.b52 as hold_52w_excess_return, g.exit_52.ts as hold_52w_exit_at
        from lasting l left join owned using (theme, decision_at) left join events e on e.theme = l.theme and e.o = owned.o left join ends on ends.theme = l.theme and ends.o = owned.o left join seen using (theme, decision_at) left join gains g on g.theme = l.theme and g.ts = l.decision_at),
    moved as (select *, exit_at is not null as matured, event_start is not null as event_metadata_available, case when event_start is not null then decision_at between event_start - interval {7 * c.weeks_before} days and event_start + interval {7 * c.weeks_after} days end as within_onset_window,
        case when base > 0 then seen / base - 1 end as realized_move, case when base > 0 and top > 0 then ln(top / base) end as total, case when base > 0 and seen > 0 then ln(seen / base) end as made from whole),
    judged as (select *, case when total > 0 then made / total end as realized_log_fraction, case when total > 0 then (total - made) / total end as remaining_move_fraction, case when total > 0 then top / seen - 1 end as remaining_upside_to_peak,
        case when not ({in_time}) then false when total > 0 then {limit} when total <= 0 then false end as within_realized_limit, {in_time} as point_in_time_ok, persistent and row_number() over (partition by theme, event_start, persistent order by decision_at) = 1 as first_signal from moved),
    eh as (select decision_at, theme, signal, persistent, matured, label, future_return, future_excess_return, entry_at, exit_at, event_start, event_peak, event_metadata_available, within_onset_window, realized_move, realized_log_fraction, remaining_move_fraction, remaining_upside_to_peak,
        within_realized_limit, point_in_time_ok, first_signal, persistent and matured and event_metadata_available and within_onset_window is not null and within_realized_limit is not null as eligible_for_early_hit, hold_52w_return, hold_52w_excess_return, hold_52w_exit_at,
        coalesce(first_signal and matured and case when event_start is not null then qualifies else label end and within_onset_window and within_realized_limit and point_in_time_ok, false) as hit from judged)
    {select}""")


EARLY_ROUNDED = ["future_return", "future_excess_return", "realized_move", "realized_log_fraction", "remaining_move_fraction", "remaining_upside_to_peak", "hold_52w_return", "hold_52w_excess_return"]


@query("early_hits", early_sql_rows(HITS, f"select * replace ({r6(*EARLY_ROUNDED)}) from eh"))
def early_hit_query(spark, sf_dir):
    return early_hit_rows(spark, sf_dir)


@query("early_hits_strict", early_sql_rows(STRICT_HITS, f"select * replace ({r6(*EARLY_ROUNDED)}) from eh"))
def early_hit_strict(spark, sf_dir):
    return early_hit_rows(spark, sf_dir, STRICT_HITS)


@query("early_hits_in_time", early_sql_rows(HITS, f"select * replace ({r6(*EARLY_ROUNDED)}) from eh", True))
def early_hit_in_time(spark, sf_dir):
    return early_hit_rows(spark, sf_dir, known=True)


REPORT_SQL = """select count(*) filter (e) as eligible, count(*) filter (e and hit) as hits, round(count(*) filter (e and hit) / nullif(count(*) filter (e), 0), 6) + 0.0 as hit_rate, count(*) filter (signal and persistent) as persistent_signals, count(*) filter (signal and matured) as matured,
    count(*) filter (e and hit) as first_hits, count(*) filter (signal and within_onset_window is not null) as window_available, count(*) filter (signal and realized_log_fraction is not null) as fraction_available, count(*) filter (e and not hit) as false_alerts,
    round(median(date_diff('day', event_start, decision_at) / 7) filter (e), 6) + 0.0 as median_lead_lag_weeks, round(median(remaining_move_fraction) filter (e), 6) + 0.0 as median_remaining_move_fraction from (select *, eligible_for_early_hit as e from eh)"""


@query("early_hits_report", early_sql_rows(HITS, REPORT_SQL))
def early_hits_report(spark, sf_dir):
    return early_hits.early_hit_report(early_hit_rows(spark, sf_dir))


@query("early_hits_by_year", early_sql_rows(HITS, "select cast(year(decision_at) as integer) as year, count(*) as false_alerts from eh where eligible_for_early_hit and not hit group by 1"))
def early_hits_by_year(spark, sf_dir):
    return early_hits.annual_false_alerts(early_hit_rows(spark, sf_dir))


# --- rank metrics: brands' scores against the next week's return ---


def score_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    rows = _metrics(spark, sf_dir, "p_brand").select(F.col("week").alias("date"), F.col("theme").alias("asset"), F.col("rs_4w").alias("score"), F.lead("theme_return").over(Window.partitionBy("theme").orderBy("week")).alias("forward_return"))
    return rows.select("date", "asset", "score"), rows.select("date", "asset", "forward_return")


SCORES = ", p as (select week as date, theme as asset, rs_4w as score, lead(theme_return) over (partition by theme order by week) as outcome from metrics), v as (select * from p where score is not null and outcome is not null)"
AVERAGE = "rank() over (partition by date order by {0}) + (count(*) over (partition by date, {0}) - 1) / 2.0"
IC = f"{SCORES}, a as (select date, {AVERAGE.format('score')} as s, {AVERAGE.format('outcome')} as o from v), c as (select date, covar_samp(s, o) / nullif(stddev_samp(s) * stddev_samp(o), 0) as ic, count(*) as n from a group by date), ic as (select d.date, case when n >= 3 then ic end as rank_ic, coalesce(n, 0) as n from (select distinct date from p) d left join c using (date))"
BUCKETS = f"""{SCORES}, a as (select *, row_number() over (partition by date order by score desc, asset) as down, row_number() over (partition by date order by score asc, asset) as up, count(*) over (partition by date) as n from v),
    m as (select date, max(n) as n, avg(outcome) as universe_mean, avg(outcome) filter (down <= greatest(1, ceil(n * 0.2::double))) as top_mean, avg(outcome) filter (up <= greatest(1, ceil(n * 0.2::double))) as bottom_mean,
        avg(cast(outcome > 0 as integer)) filter (down <= greatest(1, ceil(n * 0.2::double))) as top_hit, avg(cast(outcome > 0 as integer)) filter (up <= greatest(1, ceil(n * 0.2::double))) as bottom_hit,
        count(*) filter (down <= greatest(1, ceil(n * 0.2::double))) as top_n, count(*) filter (up <= greatest(1, ceil(n * 0.2::double))) as bottom_n from a group by date),
    k as (select d.date, coalesce(n, 0) as n, n >= 3 as ok, top_mean, bottom_mean, universe_mean, top_hit, bottom_hit, top_n, bottom_n from (select distinct date from p) d left join m using (date)),
    bk as (select date, case when ok then top_mean end as top_mean, case when ok then bottom_mean end as bottom_mean, case when ok then universe_mean end as universe_mean, case when ok then top_mean - bottom_mean end as spread, case when ok then top_mean - universe_mean end as top_universe_spread,
        case when ok then top_hit end as top_hit, case when ok then bottom_hit end as bottom_hit, n, case when ok then top_n else 0 end as top_n, case when ok then bottom_n else 0 end as bottom_n from k)"""


@query("rank_ic", with_panel(f"{IC} select date, round(rank_ic, 6) + 0.0 as rank_ic, n from ic", "p_brand"))
def rank_ic(spark, sf_dir):
    return rank_metrics.rank_ic_by_date(*score_tables(spark, sf_dir))


@query(
    "rank_ic_summary",
    with_panel(
        f"{IC} select round(avg(rank_ic), 6) + 0.0 as rank_ic_mean, round(median(rank_ic), 6) + 0.0 as rank_ic_median, round(case when count(rank_ic) > 1 then stddev_samp(rank_ic) when count(rank_ic) = 1 then 0 end, 6) + 0.0 as rank_ic_std, "
        "round(case when count(rank_ic) > 1 and stddev_samp(rank_ic) > 0 then avg(rank_ic) / stddev_samp(rank_ic) end, 6) + 0.0 as rank_ic_ir, count(rank_ic) as rank_ic_count from ic",
        "p_brand",
    ),
)
def rank_ic_summary(spark, sf_dir):
    return rank_metrics.rank_ic_summary(rank_metrics.rank_ic_by_date(*score_tables(spark, sf_dir)))


@query("top_bottom", with_panel(f"{BUCKETS} select date, {r6('top_mean', 'bottom_mean', 'universe_mean', 'spread', 'top_universe_spread', 'top_hit', 'bottom_hit')}, n, top_n, bottom_n from bk", "p_brand"))
def top_bottom(spark, sf_dir):
    return rank_metrics.buckets_by_date(*score_tables(spark, sf_dir))


@query(
    "top_bottom_summary",
    with_panel(
        f"{BUCKETS} select round(avg(spread), 6) + 0.0 as top_bottom_spread, round(median(spread), 6) + 0.0 as top_bottom_spread_median, round(avg(top_universe_spread), 6) + 0.0 as top_minus_universe_excess, round(median(top_universe_spread), 6) + 0.0 as top_minus_universe_excess_median, "
        "round(avg(top_mean), 6) + 0.0 as top_mean_return, round(avg(bottom_mean), 6) + 0.0 as bottom_mean_return, round(avg(top_hit), 6) + 0.0 as top_hit_rate, round(avg(bottom_hit), 6) + 0.0 as bottom_hit_rate, round(avg(top_hit), 6) + 0.0 as hit_rate, count(spread) as observations from bk",
        "p_brand",
    ),
)
def top_bottom_summary(spark, sf_dir):
    return rank_metrics.bucket_summary(rank_metrics.buckets_by_date(*score_tables(spark, sf_dir)))


# --- audits over features made of lineitem ---


def feature_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("decision_at"),
        F.when(F.col("l_linenumber") != 7, F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") - 5).cast("timestamp_ntz")).alias("feature_available_at"),
        F.col("l_partkey").cast("string").alias("symbol"),
        (1.0 - F.col("l_discount")).alias("coverage"),
        F.col("l_quantity").alias("history_weeks"),
        F.when(F.col("l_returnflag") == "A", "ETF").otherwise("stock").alias("asset_type"),
        F.date_add(F.to_date("l_shipdate"), -30 * (F.col("l_linenumber") - 1)).alias("membership_start"),
        F.when(F.col("l_linenumber") > 2, F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") - 4)).alias("membership_end"),
    )


FEATURES = """f as (select l_shipdate as d, case when l_linenumber <> 7 then cast(cast(l_shipdate as date) + l_linenumber - 5 as timestamp) end as a, cast(l_partkey as varchar) as symbol, 1 - l_discount as coverage, l_quantity as h, l_returnflag = 'A' as etf,
    cast(l_shipdate as date) - 30 * (l_linenumber - 1) as ms, case when l_linenumber > 2 then cast(l_shipdate as date) + l_linenumber - 4 end as me from lineitem)"""


def _audit(name: str, checks, rules: list[tuple[str, str]]) -> None:
    sql = " union all ".join(f"select '{code}' as code, count(*) as count from f where {rule}" for code, rule in rules)

    @query(name, f"with {FEATURES} select * from ({sql}) where count > 0")
    def run(spark, sf_dir):
        rows = feature_table(spark, sf_dir)
        return audits.issues(rows, checks(rows)).select("code", "count")


_audit("audit_availability", audits.availability_checks, [("invalid_feature_timestamp", "a is null or d is null"), ("feature_after_decision", "a > d")])
_audit("audit_membership", audits.membership_checks, [("missing_membership_date", "ms is null"), ("membership_out_of_range", "ms is not null and (d < ms or coalesce(d > me, false))")])
_audit("audit_history", audits.history_checks, [("insufficient_etf_history", "etf and (h is null or h < 26)")])
_audit("audit_coverage", audits.coverage_checks, [("insufficient_coverage", "coverage is null or coverage < 0.95::double")])


@query("audit_duplicates", f"with {FEATURES} select 'duplicate_feature_key' as code, sum(n)::bigint as count from (select count(*) as n from f group by d, symbol having count(*) > 1) having sum(n) is not null")
def audit_duplicates(spark, sf_dir):
    return audits.audit_duplicates(feature_table(spark, sf_dir)).select("code", "count")


# --- memberships made of orders ---


def membership_table(spark, sf_dir) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("theme_id"),
        F.col("o_custkey").cast("string").alias("permanent_id"),
        F.col("o_orderkey"),
        day.alias("valid_from"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_add(day, 90)).alias("valid_to"),
        F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).alias("evidence_available_at"),
        F.lower(F.col("o_orderpriority")).alias("exposure_tier"),
    )


MEMBERS = "m as (select o_orderstatus as theme_id, cast(o_custkey as varchar) as permanent_id, o_orderkey, cast(o_orderdate as date) as valid_from, case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) + 90 end as valid_to, cast(o_orderdate as date) + cast(o_orderkey % 30 as integer) as evidence_available_at, lower(o_orderpriority) as exposure_tier from orders)"


@query("membership_as_of", f"with {MEMBERS} select * from m where valid_from <= date '1998-01-15' and (valid_to is null or date '1998-01-15' < valid_to) and evidence_available_at <= date '1998-01-15'")
def membership_as_of(spark, sf_dir):
    return membership.memberships_as_of(membership_table(spark, sf_dir), "1998-01-15")


@query("membership_overlaps", f"with {MEMBERS}, w as (select *, lag(valid_from) over o as previous_from, lag(valid_to) over o as previous_to from m window o as (partition by theme_id, permanent_id order by valid_from, valid_to nulls last)) select theme_id, permanent_id, valid_from, previous_from, previous_to from w where previous_from is not null and (previous_to is null or valid_from < previous_to)")
def membership_overlaps(spark, sf_dir):
    return membership.overlaps(membership_table(spark, sf_dir)).select("theme_id", "permanent_id", "valid_from", "previous_from", "previous_to")


@query("unknown_theme_fk", f"with {MEMBERS} select theme_id, permanent_id, o_orderkey from m where theme_id not in ('O', 'F')")
def unknown_theme_fk(spark, sf_dir):
    themes = spark.createDataFrame([("O",), ("F",)], "theme_id string")
    return membership.unknown_themes(membership_table(spark, sf_dir), themes).select("theme_id", "permanent_id", "o_orderkey")


@query("theme_counts", f"with {MEMBERS}, t(theme_id) as (values ('O'), ('F'), ('none')) select theme_id, count(o_orderkey) as members from t left join m using (theme_id) group by theme_id")
def theme_counts(spark, sf_dir):
    return membership.theme_counts(spark.createDataFrame([("O",), ("F",), ("none",)], "theme_id string"), membership_table(spark, sf_dir))


WALK = SplitConfig(n_splits=4, test_size=20, train_size=150, embargo=4, min_train_size=10)


@query(
    "walk_forward",
    with_panel(
        """, d as (select cast(week as timestamp) as date, row_number() over (order by week) - 1 as pos, cast(week + 91 as timestamp) as label_end, count(*) over () as n from cal),
        k as (select unnest(range(0, 4)) as k), f as (select k, n - 80 + 20 * k as start, n - 80 + 20 * (k - 1) + 19 as previous from k, (select max(n) as n from d)),
        r as (select k, pos, date, case when pos between start and start + 19 then 'test' when pos < start and pos >= start - 150 and (k = 0 or pos <= previous or pos > previous + 4)
            and label_end < (select date from d d2 where d2.pos = start) and pos < start - 4 then 'train' end as role from d, f)
        select cast(k as integer) as split_id, role, cast(pos as integer) as pos, date from r where role is not null""".lstrip()
    ),
)
def walk_forward(spark, sf_dir):
    from fathomline.operators.panel import weeks

    dates = weeks(_panel(spark, sf_dir).observed).select(F.col("week").cast("timestamp_ntz").alias("date"), F.date_add("week", 91).cast("timestamp_ntz").alias("label_end"))
    return splits.purged_walk_forward_splits(dates, WALK)


# --- scorecards and file checks ---


def entity_records(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg((100 + F.avg("o_totalprice") / 10000).alias("value"))


@query(
    "scorecard",
    f"""with r as (select o_orderpriority as entity, cast(date_trunc('month', o_orderdate) as date) as date, 100 + avg(o_totalprice) / 10000 as value from orders group by all),
    s as (select *, lag(value) over (partition by entity order by date) as b from r),
    e as (select entity, max(date) as as_of, count(*) as n, min_by(value, date) as f, max_by(value, date) as l, count(b) as k, stddev_pop(value / b - 1) as dev from s group by entity),
    c as (select *, case when n >= 2 then l / f - 1 else 0 end as growth, case when k >= 2 then dev else 0 end as vol from e),
    m as (select *, least(greatest(50 + growth * 150, 0), 100) as momentum, least(greatest(25 + n / 12.0 * 75, 0), 100) as breadth, least(greatest(35 + least(1, n / 20.0) * 65, 0), 100) as quality, least(greatest(100 - vol * 500, 0), 100) as risk_control, 0.55 * least(1, n / 20.0) + 0.25 + case when n >= 2 then 0.20 else 0 end as conf from c),
    t as (select *, 0.4 * momentum + 0.25 * breadth + 0.2 * quality + 0.15 * risk_control as sc, cast(greatest(date '2002-01-01' - as_of, 0) as integer) as age from m)
    select entity, round(sc, 2) + 0.0 as score, case when sc >= 70 then 'Current Leader' when sc >= 50 then 'Emerging Radar' else '12M Hold Candidate' end as bucket, round(momentum, 2) + 0.0 as momentum, round(breadth, 2)::double + 0.0 as breadth, round(quality, 2)::double + 0.0 as quality, round(risk_control, 2) + 0.0 as risk_control,
        round(conf * 100, 1)::double + 0.0 as data_confidence, round(conf, 3)::double + 0.0 as confidence, case when conf >= 0.8 then 'High' when conf >= 0.55 then 'Medium' else 'Low' end as confidence_label,
        case when len(fl) = 0 then 'none flagged' else array_to_string(fl, '; ') end as risk_flags, as_of, age as freshness_days, n as observations, '{scorecard.DISCLAIMER}' as disclaimer
    from (select *, list_filter([case when n < 5 then 'sparse history' end, case when vol > 0.08 then 'high volatility' end, case when age > 45 then 'stale data' end], lambda x: x is not null) as fl from t)""",
)
def scorecard_query(spark, sf_dir):
    return scorecard.scorecard(entity_records(spark, sf_dir), TODAY)


@query("unpivot_wide", "select date, entity, round(value, 6) + 0.0 as value from (select l_shipdate as date, l_quantity, l_extendedprice, l_discount from lineitem) unpivot (value for entity in (l_quantity, l_extendedprice, l_discount))")
def unpivot_wide(spark, sf_dir):
    return unpivoted(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_discount"), "date")


@query(
    "validate_file",
    """with r as (select user_id as e, case when event_id % 50 = 0 then null else date_trunc('hour', ts) end as d, case when event_id % 20 <> 0 then value end as v, event_id % 50 = 0 as bad from events)
    select (select count(*) from r) as rows, (select count(distinct e) from r) as entities, (select sum(n - 1)::bigint from (select count(*) as n from r where d is not null group by e, d)) as duplicates, (select count(*) from r where bad) as unparseable_dates, (select count(v) from r) as numeric_values""",
)
def validate_file(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity"),
        F.when(F.col("event_id") % 50 == 0, "no date").otherwise(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss")).alias("date"),
        F.when(F.col("event_id") % 20 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("value").cast("string"))).alias("value"),
    )
    return scorecard.validation_counts(rows)

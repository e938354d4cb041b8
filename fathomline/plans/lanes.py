"""Three weekly lanes over one shared metrics table: current leaders, the emerging watch list, and twelve-month candidates.

A lane takes the metrics and gives one row for each theme and week, rejected ones too, with its scores, gates, status and warnings. Statuses are one CASE each.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import CurrentLeaderConfig, EmergingRadarConfig, HoldCandidateConfig
from fathomline.functions.expr import before_now, choose, clipped, gate, warnings_text

#: Fixed value: what every row of the watch list says.
RECOMMENDATION = "WATCH_ONLY_NOT_A_BUY_RECOMMENDATION"

COMMON = ["m0_26w_spy_relative", "m0_rank", "m0_available", "benchmark_26w_available"]


def _base(metrics: DataFrame, as_of: date | str | None) -> DataFrame:
    """The metrics with the columns that all lanes share. as_of trims decision dates, after all windows are made."""
    rows = metrics.withColumns(
        {
            "decision_date": F.col("week"),
            "signal_date": F.col("week"),
            "decision_weekday": F.date_format("week", "EEEE"),
            "effective_is_next_session": F.coalesce(F.col("effective_date") > F.col("week").cast("timestamp_ntz"), F.lit(False)),
            "m0_26w_spy_relative": F.col("m0"),
            "m0_26w_spy_relative_rank": F.col("m0_rank"),
            "m0_available": F.col("m0").isNotNull(),
            "m0_baseline_available": F.col("m0").isNotNull(),
            "benchmark_26w_available": F.col("m0_benchmark").isNotNull(),
        }
    )
    return rows if as_of is None else rows.where(F.col("week") <= F.to_date(F.lit(str(as_of))))


SHARED = ["decision_date", "theme", *COMMON]
TAIL = ["status", "warnings", "effective_date", "signal_date", "decision_weekday", "effective_is_next_session", "m0_26w_spy_relative_rank", "m0_baseline_available"]


def _at_least(column: str, least: float) -> Column:
    return F.col(column) >= F.lit(float(least))


def current_leader(metrics: DataFrame, config: CurrentLeaderConfig | None = None, as_of: date | str | None = None) -> DataFrame:
    c = config or CurrentLeaderConfig()
    w = c.score_weights
    breadth = (F.col("breadth_13w") + F.col("breadth_26w") + F.col("breadth_52w")) / 3.0
    rows = _base(metrics, as_of).withColumn("breadth_average", breadth)
    rows = rows.withColumn("leader_score", w[0] * F.col("rs_rank_13w") + w[1] * F.col("rs_rank_26w") + w[2] * F.col("rs_rank_52w") + w[3] * F.col("breadth_average"))
    rows = rows.withColumns(
        {
            "_history": gate(_at_least("history_weeks", c.min_history_weeks)),
            "_finite": F.col("rs_13w").isNotNull() & F.col("rs_26w").isNotNull() & F.col("rs_52w").isNotNull(),
            "m0_baseline_pass": gate(_at_least("m0", c.min_relative_strength)),
            "breadth_gate_pass": gate(*(_at_least(f"breadth_{n}w", c.min_breadth) for n in (13, 26, 52))),
            "participation_gate_pass": gate(_at_least("participation", c.min_participation)),
        }
    )
    rows = rows.withColumn("_gate", F.col("_finite") & F.col("_history") & F.col("m0_baseline_pass") & F.col("breadth_gate_pass") & F.col("participation_gate_pass"))
    rows = rows.withColumn("_eligible", F.when(F.col("_gate"), F.col("leader_score")))
    rows = rows.withColumn("leader_rank", F.rank().over(Window.partitionBy("week").orderBy(F.col("_eligible").desc_nulls_last())).cast("double"))
    rows = rows.withColumn("is_current_leader", gate(F.col("_gate"), _at_least("_eligible", c.min_score), F.col("leader_rank") <= c.leader_count))
    ready = F.col("_history") & F.col("_finite")
    status = choose(
        (F.col("is_current_leader"), "current_leader"),
        (F.col("_gate"), "eligible_not_top"),
        (ready & (~F.col("participation_gate_pass") | ~F.col("breadth_gate_pass")), "warning"),
        (~ready, "insufficient_history"),
        otherwise="not_leader",
    )
    rows = rows.withColumn("status", status)
    rows = rows.withColumn(
        "warnings",
        warnings_text(
            (F.col("status") == "insufficient_history", "insufficient_history"),
            (~F.col("benchmark_26w_available"), "missing_spy_26w_baseline"),
            (~F.col("m0_baseline_pass") & F.col("m0").isNotNull(), "negative_m0_26w_spy_relative"),
            (~F.col("breadth_gate_pass"), "breadth_below_threshold"),
            (~F.col("participation_gate_pass"), "low_participation"),
            (F.col("status") == "eligible_not_top", "ranked_below_leader_cut"),
        ),
    )
    own = ["rs_13w", "rs_26w", "rs_52w", "rs_rank_13w", "rs_rank_26w", "rs_rank_52w", "breadth_13w", "breadth_26w", "breadth_52w", "breadth_average", "participation", "history_weeks"]
    return rows.select(*SHARED, *own, "leader_score", "leader_rank", "m0_baseline_pass", "breadth_gate_pass", "participation_gate_pass", "is_current_leader", *TAIL, F.col("warnings").alias("warning"))


def emerging_radar(metrics: DataFrame, config: EmergingRadarConfig | None = None, as_of: date | str | None = None) -> DataFrame:
    c = config or EmergingRadarConfig()
    rows = _base(metrics, as_of).withColumns(
        {
            "rank_improvement_4v13": F.col("rs_rank_4w") - F.col("rs_rank_13w"),
            "rank_improvement_4v8": F.col("rs_rank_4w") - F.col("rs_rank_8w"),
            "breadth_average": 0.50 * F.col("breadth_4w") + 0.30 * F.col("breadth_8w") + 0.20 * F.col("breadth_13w"),
            "concentration_max": F.greatest("concentration_4w", "concentration_8w", "concentration_13w"),
            "top_security_share_4w": F.col("top_share_4w"),
        }
    )
    score = (
        0.35 * F.col("acceleration_rank")
        + 0.25 * F.col("rs_rank_4w")
        + 0.20 * clipped(F.col("rank_improvement_4v13"), 0.0, 1.0)
        + 0.10 * F.col("breadth_average")
        + 0.10 * F.col("participation")
    )
    rows = rows.withColumns(
        {
            "radar_score": score,
            "_ready": gate(_at_least("history_weeks", c.min_history_weeks), F.col("rs_4w").isNotNull(), F.col("acceleration").isNotNull()),
            "m0_baseline_pass": gate(_at_least("m0", 0.0)),
            "acceleration_gate_pass": gate(_at_least("acceleration_rank", c.min_acceleration_rank)),
            "rank_improvement_gate_pass": gate(_at_least("rank_improvement_4v13", c.min_rank_improvement)),
            "breadth_gate_pass": gate(_at_least("breadth_4w", c.min_fast_breadth)),
            "participation_gate_pass": gate(_at_least("participation", c.min_participation_for_watch)),
            "concentration_gate_pass": gate(F.col("concentration_max") <= c.max_concentration),
        }
    )
    watch = gate(
        F.col("_ready"),
        F.col("participation_gate_pass"),
        F.col("rank_improvement_gate_pass"),
        F.col("acceleration_gate_pass"),
        _at_least("rs_4w", c.min_fast_relative_strength),
        _at_least("radar_score", c.score_threshold),
    )
    rows = rows.withColumn("is_watchlist", watch)
    status = choose(
        (F.col("is_watchlist"), "watch"),
        (F.col("_ready") & (~F.col("participation_gate_pass") | ~F.col("breadth_gate_pass") | ~F.col("concentration_gate_pass")), "warning"),
        (~F.col("_ready"), "insufficient_history"),
        otherwise="not_watch",
    )
    rows = rows.withColumn("status", status)
    rows = rows.withColumn(
        "warnings",
        warnings_text(
            (F.lit(True), "watchlist_only_not_a_buy_recommendation"),
            (F.col("status") == "insufficient_history", "insufficient_history"),
            (~F.col("benchmark_26w_available"), "missing_spy_26w_baseline"),
            (F.col("m0").isNotNull() & ~F.col("m0_baseline_pass"), "negative_m0_26w_spy_relative"),
            (F.col("breadth_4w").isNotNull() & ~F.col("breadth_gate_pass"), "low_breadth"),
            (F.col("participation").isNotNull() & ~F.col("participation_gate_pass"), "low_participation"),
            (F.col("concentration_max").isNotNull() & ~F.col("concentration_gate_pass"), "concentrated_rally"),
            (F.col("rank_improvement_4v13").isNotNull() & ~F.col("rank_improvement_gate_pass"), "rank_not_improving"),
        ),
    )
    own = ["rs_4w", "rs_8w", "rs_13w", "rs_rank_4w", "rs_rank_8w", "rs_rank_13w", "accel_4v8", "accel_8v13", "acceleration", "acceleration_rank", "rank_improvement_4v13", "rank_improvement_4v8"]
    own += ["breadth_4w", "breadth_8w", "breadth_13w", "breadth_average", "participation", "concentration_4w", "concentration_8w", "concentration_13w", "concentration_max", "top_security_share_4w"]
    own += ["history_weeks", "radar_score", "m0_baseline_pass", "acceleration_gate_pass", "rank_improvement_gate_pass", "breadth_gate_pass", "participation_gate_pass", "concentration_gate_pass"]
    return rows.select(*SHARED, *own, "is_watchlist", *TAIL, F.col("warnings").alias("warning"), F.lit(RECOMMENDATION).alias("recommendation"), F.lit(True).alias("not_a_buy_recommendation"))


def hold_candidate_12m(metrics: DataFrame, config: HoldCandidateConfig | None = None, as_of: date | str | None = None) -> DataFrame:
    c = config or HoldCandidateConfig()
    rows = _base(metrics, None).withColumns(
        {
            "breadth_average": (F.col("breadth_13w") + F.col("breadth_26w") + F.col("breadth_52w")) / 3.0,
            "concentration_max": F.greatest("concentration_13w", "concentration_26w", "concentration_52w"),
            "durability_score": 0.30 * F.col("breadth_13w") + 0.35 * F.col("breadth_26w") + 0.20 * F.col("breadth_52w") + 0.15 * F.col("participation"),
            "m0_baseline_pass": gate(_at_least("m0", c.min_relative_strength)),
            "rs_gate_pass": gate(*(_at_least(f"rs_{n}w", c.min_relative_strength) for n in (13, 26, 52))),
        }
    )
    durable = gate(*(_at_least(f"breadth_{n}w", c.min_breadth) for n in (13, 26, 52)), _at_least("participation", c.min_participation), _at_least("durability_score", c.min_durability_score))
    risk = gate(
        F.col("concentration_max") <= c.max_concentration, F.col("annualized_volatility_26w") <= c.max_annualized_volatility, _at_least("max_drawdown_52w", -c.max_drawdown)
    )
    rows = rows.withColumns({"durability_gate_pass": durable, "risk_gate_pass": risk})
    by = before_now(Window.partitionBy("theme").orderBy("week"), c.confirmation_window)
    raw = (F.col("rs_gate_pass") & F.col("m0_baseline_pass") & F.col("durability_gate_pass")).cast("double")
    rows = rows.withColumn("confirmation_count", F.when(F.count(F.lit(1)).over(by) == c.confirmation_window, F.sum(raw).over(by)))
    if as_of is not None:
        rows = rows.where(F.col("week") <= F.to_date(F.lit(str(as_of))))
    score = (
        0.35 * (F.col("rs_rank_13w") + F.col("rs_rank_26w") + F.col("rs_rank_52w")) / 3.0
        + 0.35 * F.col("durability_score")
        + 0.15 * (1.0 - clipped(F.col("annualized_volatility_26w") / c.max_annualized_volatility, high=1.0))
        + 0.15 * (1.0 + clipped(F.col("max_drawdown_52w") / c.max_drawdown, -1.0, 0.0))
    )
    there = ("rs_13w", "rs_26w", "rs_52w", "breadth_average", "annualized_volatility_26w", "max_drawdown_52w")
    rows = rows.withColumns(
        {
            "candidate_score": score,
            "confirmation_gate_pass": gate(_at_least("confirmation_count", c.min_confirmed_weeks)),
            "_ready": gate(_at_least("history_weeks", c.min_history_weeks), *(F.col(n).isNotNull() for n in there)),
        }
    )
    strong = F.col("rs_gate_pass") & F.col("m0_baseline_pass")
    sound = strong & F.col("durability_gate_pass")
    safe = sound & F.col("risk_gate_pass")
    rows = rows.withColumn("is_hold_candidate", gate(F.col("_ready"), safe, F.col("confirmation_gate_pass"), _at_least("candidate_score", c.min_score)))
    status = choose(
        (F.col("is_hold_candidate"), "hold_candidate"),
        (F.col("_ready") & safe & ~F.col("confirmation_gate_pass"), "awaiting_confirmation"),
        (F.col("_ready") & sound & ~F.col("risk_gate_pass"), "risk_rejected"),
        (F.col("_ready") & (~strong | ~F.col("durability_gate_pass")), "warning"),
        (~F.col("_ready"), "insufficient_history"),
        otherwise="not_candidate",
    )
    rows = rows.withColumn("status", status)
    risky = F.col("concentration_max").isNotNull() & ~F.col("risk_gate_pass")
    rows = rows.withColumn(
        "warnings",
        warnings_text(
            (F.col("status") == "insufficient_history", "insufficient_history"),
            (~F.col("benchmark_26w_available"), "missing_spy_26w_baseline"),
            (F.col("m0").isNotNull() & ~F.col("m0_baseline_pass"), "negative_m0_26w_spy_relative"),
            (F.col("rs_13w").isNotNull() & ~F.col("rs_gate_pass"), "relative_strength_gate_failed"),
            (F.col("durability_score").isNotNull() & ~F.col("durability_gate_pass"), "durability_gate_failed"),
            (risky & (F.col("concentration_max") > c.max_concentration), "concentrated_rally"),
            (risky & (F.col("annualized_volatility_26w") > c.max_annualized_volatility), "high_volatility"),
            (risky & (F.col("max_drawdown_52w") < -c.max_drawdown), "deep_drawdown"),
            (F.col("status") == "awaiting_confirmation", "awaiting_confirmation"),
        ),
    )
    own = ["rs_13w", "rs_26w", "rs_52w", "rs_rank_13w", "rs_rank_26w", "rs_rank_52w", "breadth_13w", "breadth_26w", "breadth_52w", "breadth_average", "participation"]
    own += ["concentration_13w", "concentration_26w", "concentration_52w", "concentration_max", "annualized_volatility_26w", "max_drawdown_52w", "durability_score", "confirmation_count"]
    own += ["candidate_score", "history_weeks", "m0_baseline_pass", "rs_gate_pass", "durability_gate_pass", "risk_gate_pass", "confirmation_gate_pass"]
    return rows.select(*SHARED, *own, "is_hold_candidate", *TAIL, F.col("warnings").alias("warning"))

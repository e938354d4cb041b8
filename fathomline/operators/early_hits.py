"""Whether signals came early: persistence, timing against the onset, share of the move already made, and the report over all signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import EarlyHitConfig
from fathomline.functions.expr import before_now, gate
from fathomline.operators.asof import largest_at_or_before, last_at_or_before
from fathomline.operators.labels import future_labels
from fathomline.operators.selection import exact_medians
from fathomline.sources.shared import written


def persistent(signal: str, config: EarlyHitConfig, by: str = "theme", at: str = "decision_at"):
    """A signal with at least persistence_count signals among the last decisions of its window, itself included; without a window all of the last persistence_count."""
    over = before_now(Window.partitionBy(by).orderBy(at), config.window)
    fired = F.coalesce(F.col(signal), F.lit(False))
    return fired & (F.sum(fired.cast("int")).over(over) >= config.persistence_count)


def price_at_or_before(asks: DataFrame, series: DataFrame, at: str, out: str, by: str = "theme") -> DataFrame:
    """Adds the last price at or before asks.<at>."""
    return last_at_or_before(asks, series, by, at, "ts", F.col("price"), out)


def event_at_or_before(asks: DataFrame, events: DataFrame, by: str = "theme") -> DataFrame:
    """Adds _event: of the events (by, onset, ..., _order) that have begun by decision_at, the last in _order."""
    fact = F.struct("_order", *(c for c in events.columns if c not in (by, "_order")))
    return largest_at_or_before(asks, events, by, "decision_at", "onset", fact, "_event")


def evaluate_early_hits(
    signals: DataFrame,
    series: DataFrame,
    episodes: DataFrame | None = None,
    config: EarlyHitConfig | None = None,
    absolute_threshold: float | None = 0.80,
    excess_threshold: float | None = 0.40,
    require_point_in_time: bool = False,
    by: str = "theme",
    starts: DataFrame | None = None,
    peaks: DataFrame | None = None,
) -> DataFrame:
    """One row for each decision of signals (theme, decision_at, signal [, feature_available_at]).

    episodes: (theme, onset, peak, qualifies [, row_order]); a decision belongs to the last of them, in row order (that of onsets where there is none), that has begun by then. starts and peaks (theme, decision_at, onset or peak) say either for
    single decisions and come before those of the episode. A hit is the first persistent signal of its episode, matured, inside the window around the onset, with less than log_fraction of the onset-to-peak log move made, and known in time.
    """
    c = config or EarlyHitConfig()
    h = f"{c.horizon_weeks}w"
    forward = future_labels(series, sorted({c.horizon_weeks, 52}), c.next_session, absolute_threshold, excess_threshold, by, drawdown=False)
    own = {"label": f"label_{h}", "future_return": f"future_{h}_return", "future_excess_return": f"future_{h}_excess_return", "entry_at": f"entry_at_{h}", "exit_at": f"exit_at_{h}"}
    own |= {"hold_52w_return": "future_52w_return", "hold_52w_excess_return": "future_52w_excess_return", "hold_52w_exit_at": "exit_at_52w"}
    forward = forward.select(by, "decision_at", *(F.col(c_).alias(n) for n, c_ in own.items()))
    rows = signals.withColumn("signal", F.coalesce(F.col("signal"), F.lit(False))).withColumn("persistent", persistent("signal", c, by))
    if episodes is None:
        rows = rows.withColumn("_event", F.lit(None).cast("struct<onset:timestamp_ntz,peak:timestamp_ntz,qualifies:boolean,_base:double,_top:double>"))
    else:
        order = F.col("row_order") if "row_order" in episodes.columns else F.row_number().over(Window.partitionBy(by).orderBy("onset", "peak"))
        events = episodes.where(F.col("onset").isNotNull()).select(by, "onset", "peak", "qualifies", order.alias("_order"))
        # what an episode's prices are doesn't hang on the decision
        events = price_at_or_before(price_at_or_before(events, series, "onset", "_base", by), series, "peak", "_top", by)
        rows = event_at_or_before(rows, events, by)
    rows = rows.join(forward, [by, "decision_at"], "left")
    rows = rows.select("*", F.col("_event.onset").alias("event_start"), F.col("_event.peak").alias("event_peak"), F.col("_event._base").alias("_base"), F.col("_event._top").alias("_top"), F.col("_event.qualifies").alias("_qualifies"), F.col("_event").isNotNull().alias("_has_event")).drop("_event")
    for given, name, at, price in ((starts, "onset", "event_start", "_base"), (peaks, "peak", "event_peak", "_top")):
        if given is not None:
            single = price_at_or_before(given.select(by, "decision_at", F.col(name).alias("_given")), series, "_given", "_price", by)
            rows = rows.join(single, [by, "decision_at"], "left").withColumns({price: F.when(F.col("_given").isNotNull(), F.col("_price")).otherwise(F.col(price)), at: F.coalesce("_given", at)}).drop("_given", "_price")
    rows = price_at_or_before(rows, series, "decision_at", "_seen", by)
    week = F.make_dt_interval(F.lit(7))
    metadata = F.col("event_start").isNotNull() & F.col("event_peak").isNotNull()
    priced = metadata & (F.col("_base") > 0) & F.col("_seen").isNotNull()
    total = F.when(priced & (F.col("_top") > 0), F.ln(F.try_divide("_top", "_base")))
    made = F.when(priced & (F.col("_top") > 0) & (F.col("_seen") > 0), F.ln(F.try_divide("_seen", "_base")))
    rows = rows.withColumns(
        {
            "matured": F.col("exit_at").isNotNull(),
            "event_metadata_available": metadata,
            "within_onset_window": F.when(F.col("event_start").isNotNull(), F.col("decision_at").between(F.col("event_start") - week * c.weeks_before, F.col("event_start") + week * c.weeks_after)),
            "realized_move": F.when(priced, F.try_divide("_seen", "_base") - 1.0),
            "_total": total,
            "realized_log_fraction": F.when(total > 0, made / total),
            "remaining_move_fraction": F.when(total > 0, (total - made) / total),
            "remaining_upside_to_peak": F.when(total > 0, F.try_divide("_top", "_seen") - 1.0),
            "point_in_time_ok": gate(F.col("feature_available_at") <= F.col("decision_at")) if "feature_available_at" in signals.columns else F.lit(True),
        }
    )
    below = F.lit(True) if c.log_fraction is None else gate(F.col("realized_log_fraction") < c.log_fraction)
    limit = F.when(F.col("_total") > 0, below).when(F.col("_total") <= 0, False)
    if require_point_in_time:
        limit = F.when(~F.col("point_in_time_ok"), False).otherwise(limit)
    rows = rows.withColumn("within_realized_limit", limit)
    first = F.row_number().over(Window.partitionBy(by, "event_start", "persistent").orderBy("decision_at")) == 1
    rows = rows.withColumn("first_signal", F.col("persistent") & first)
    qualifies = F.when(F.col("_has_event"), F.col("_qualifies")).otherwise(F.col("label"))
    rows = rows.withColumn("hit", gate(F.col("first_signal"), F.col("matured"), qualifies, F.col("within_onset_window"), F.col("within_realized_limit"), F.col("point_in_time_ok")))
    rows = rows.withColumn("eligible_for_early_hit", F.col("persistent") & F.col("matured") & metadata & F.col("within_onset_window").isNotNull() & F.col("within_realized_limit").isNotNull())
    names = ["signal", "persistent", "matured", "label", "future_return", "future_excess_return", "entry_at", "exit_at", "event_start", "event_peak", "event_metadata_available", "within_onset_window", "realized_move"]
    names += ["realized_log_fraction", "remaining_move_fraction", "remaining_upside_to_peak", "within_realized_limit", "point_in_time_ok", "first_signal", "eligible_for_early_hit"]
    return rows.select("decision_at", by, *names, "hold_52w_return", "hold_52w_excess_return", "hold_52w_exit_at", "hit")


def early_hit_report(rows: DataFrame) -> DataFrame:
    """One row of counts, rates and exact medians over the rows of evaluate_early_hits. What it needs of them, a few columns, is written once; the medians come from histograms of it, so no task holds all values."""
    e, s = F.col("eligible_for_early_hit"), F.col("signal")
    lead = F.datediff("decision_at", "event_start") / 7.0
    rows = rows.select(
        "signal", "persistent", "matured", "hit", "eligible_for_early_hit", F.col("within_onset_window").isNotNull().alias("_window"), F.col("realized_log_fraction").isNotNull().alias("_fraction"), F.when(e, lead).alias("_lead"), F.when(e, F.col("remaining_move_fraction")).alias("_left")
    )
    rows = written(rows, "early-hits")
    medians = exact_medians(rows, ["_lead", "_left"])
    return rows.agg(
        F.count_if(e).alias("eligible"),
        F.count_if(e & F.col("hit")).alias("hits"),
        F.try_divide(F.count_if(e & F.col("hit")).cast("double"), F.nullif(F.count_if(e), F.lit(0))).alias("hit_rate"),
        F.count_if(s & F.col("persistent")).alias("persistent_signals"),
        F.count_if(s & F.col("matured")).alias("matured"),
        F.count_if(e & F.col("hit")).alias("first_hits"),
        F.count_if(s & F.col("_window")).alias("window_available"),
        F.count_if(s & F.col("_fraction")).alias("fraction_available"),
        F.count_if(e & ~F.col("hit")).alias("false_alerts"),
        F.lit(medians["_lead"]).cast("double").alias("median_lead_lag_weeks"),
        F.lit(medians["_left"]).cast("double").alias("median_remaining_move_fraction"),
    )


def annual_false_alerts(rows: DataFrame) -> DataFrame:
    """Eligible decisions without a hit, by year."""
    return rows.where("eligible_for_early_hit and not hit").groupBy(F.year("decision_at").alias("year")).agg(F.count("*").alias("false_alerts"))

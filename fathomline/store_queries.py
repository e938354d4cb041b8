"""Queries of the observation store and of runs that go on from kept metrics, each with its DuckDB twin over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.more_queries import lane_sql
from fathomline.plans.incremental import refreshed_metrics, run_from_store
from fathomline.queries import EASY_HOLD, EASY_LEADER, EASY_RADAR, WEEK, query, r6, with_panel
from fathomline.sources.shared import scratch
from fathomline.sources.store import ObservationStore
from fathomline.sources.testdata import events_panel, lineitem_panel

METRICS = ["theme_index", "history_weeks", "participation", "m0", "m0_rank", "breadth_13w", "annualized_volatility_26w", "max_drawdown_52w", "acceleration_rank"]
EVENTS = "select *, cast(ts as date) + case when ts > cast(ts as date) then 1 else 0 end as upto from events"


@query(
    "store_as_of",
    f"with e as ({EVENTS}), d as (select median(upto) as day, min({WEEK.format('ts')}) as start from (select upto, ts from e)) select {WEEK.format('ts')} as week, event_type as theme, upper(cast(user_id as varchar)) as security, "
    "round(max_by(value, (ts, event_id, value)), 6) + 0.0 as price from e, d where value > 0 and upto <= cast(day as date) and "
    f"{WEEK.format('ts')} >= start + 7 group by all",
)
def store_as_of(spark, sf_dir):
    """Weekly last values of the first half of the days but for the first week, out of a store that got its rows in three batches, the last days first and one batch twice, and was compacted in between."""
    rows, store = events_panel(spark, sf_dir), ObservationStore(spark, scratch(spark, "store"), buckets=8)
    part = F.pmod(F.col("event_id"), F.lit(3))
    store.append(rows.where(part == 2), "event_id")
    store.append(rows.where(part == 0), "event_id")
    store.compact()
    store.append(rows.where(part == 1), "event_id")
    store.append(rows.where(part == 0), "event_id")
    upto = F.date_add(F.to_date("date"), F.when(F.col("date").cast("timestamp_ntz") > F.to_date("date").cast("timestamp_ntz"), 1).otherwise(0))
    day = F.timestamp_seconds(F.median(F.unix_seconds(upto.cast("timestamp")))).cast("date")
    ends = rows.agg(day.alias("day"), F.date_add(F.min(F.next_day(F.date_sub(F.to_date("date"), 1), "FRI")), 7).alias("first")).first()
    return store.observed(ends["day"], first=ends["first"]).where("price is not null").select("week", "theme", "security", "price")


def _batches(spark, sf_dir) -> ObservationStore:
    """The panel of lineitem in three batches: most rows before 1998; late rows of 1997; and 1998. Metrics are refreshed after the first."""
    rows, store = lineitem_panel(spark, sf_dir), ObservationStore(spark, scratch(spark, "store"), buckets=8)
    day = F.to_date("date")
    late = (day >= "1997-09-01") & (day < "1998-01-01") & (F.col("security") == "3")
    store.append(rows.where((day < "1998-01-01") & ~late))
    refreshed_metrics(store)
    store.append(rows.where(late))
    store.append(rows.where(day >= "1998-01-01"))
    return store


@query("store_refreshed_metrics", with_panel(f"select week, theme, cast(members_seen as bigint) as members_seen, {r6(*METRICS)}, effective_date from metrics"))
def store_refreshed_metrics(spark, sf_dir):
    """Metrics that were made again from the oldest late row on; weeks before it come from the snapshot."""
    rows, since = refreshed_metrics(_batches(spark, sf_dir))
    if since.isoformat() < "1997-08-01":
        raise AssertionError(f"made again from {since} on, though nothing before September 1997 changed")
    return rows.select("week", "theme", "members_seen", *METRICS, "effective_date")


@query("store_run", lane_sql("lane_status_counts"))
def store_run(spark, sf_dir):
    """The manifest of a run over the store."""
    return run_from_store(_batches(spark, sf_dir), None, EASY_LEADER, EASY_RADAR, EASY_HOLD).manifest()

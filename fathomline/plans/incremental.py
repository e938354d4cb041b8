"""Runs that read only what is new: metrics of a store, kept as a snapshot and made again from the oldest changed week on."""

from __future__ import annotations

import dataclasses
import json
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import CurrentLeaderConfig, EmergingRadarConfig, HoldCandidateConfig, PanelConfig
from fathomline.functions.expr import WINDOWS, so_far
from fathomline.operators.metrics import theme_metrics
from fathomline.operators.panel import Panel
from fathomline.plans import lanes
from fathomline.plans.pipeline import PipelineError, SignalRun
from fathomline.sources.provenance import SnapshotCache, SourceManifest
from fathomline.sources.store import ObservationStore, merged


def first_stale_week(previous: DataFrame, changed: datetime) -> date:
    """From which week on metrics may differ once a row at `changed` is added or taken away: its own week, weeks whose next session isn't before it, and the last week, whose next session may only now be known."""
    friday = changed.date() + timedelta(days=(4 - changed.weekday()) % 7)
    at = F.to_timestamp_ntz(F.lit(changed.isoformat(sep=" ")))
    found = previous.agg(F.min(F.when(F.col("effective_date") >= at, F.col("week"))).alias("open"), F.max("week").alias("last")).first()
    return min(d for d in (friday, found["open"], found["last"]) if d is not None)


def metrics_from(store: ObservationStore, config: PanelConfig, previous: DataFrame, since: date, as_of: date | str) -> DataFrame | None:
    """Metrics of the weeks from `since` on, made of the state of those weeks and of as many before them as the longest window needs; None if they don't suffice, since a theme is new to the previous metrics.

    What reaches back to the start is carried: members that were seen before stand in a week before the cut (with an empty week between, so they give no return), and theme_index and history_weeks go on from the previous metrics.
    """
    cut = since - timedelta(weeks=max(WINDOWS))
    stand_in = F.lit(cut - timedelta(weeks=2))
    carried = store.members(cut, as_of).select(stand_in.alias("week"), "theme", "security", F.when(F.col("seen"), 1.0).alias("price"), *(F.lit(None).cast("timestamp_ntz").alias(n) for n in ("late_session", "session")))
    observed = store.observed(as_of, first=cut).unionByName(carried)
    known = previous.select("theme").distinct()
    if not observed.where(F.col("security") != config.benchmark).select("theme").distinct().join(known, "theme", "left_anti").isEmpty():
        return None
    own = theme_metrics(Panel.of_observed(observed, config)).where(F.col("week") >= F.lit(since))
    before = previous.where(F.col("week") < F.lit(since)).groupBy("theme").agg(F.max_by("theme_index", F.when(F.col("theme_index").isNotNull(), F.col("week"))).alias("_index"), F.max("history_weeks").alias("_history"))
    by = so_far(Window.partitionBy("theme").orderBy("week"))
    own = own.join(before, "theme", "left")
    growth = F.coalesce("_index", F.lit(100.0)) * F.product(F.lit(1.0) + F.col("theme_return")).over(by)
    history = F.coalesce("_history", F.lit(0.0)) + F.count("theme_return").over(by).cast("double")
    return own.withColumns({"theme_index": F.when(F.col("theme_return").isNotNull(), growth), "history_weeks": history}).select(*previous.columns)


def refreshed_metrics(store: ObservationStore, config: PanelConfig | None = None, as_of: date | str | None = None) -> tuple[DataFrame, date | None]:
    """The metrics (operators.metrics.theme_metrics) of all rows in the store up to the midnight of as_of, and the week from which on they were made again: None if nothing changed.

    They are kept in the store's folder, a snapshot for each panel setting, which says what changes it has taken up (store.forget() drops notes that all settings have). Weeks before the oldest change since the last refresh, and since the earlier of the two as-of days, are taken from the snapshot; all weeks are made again where there is none or a theme is new. A refresh that fails leaves the snapshot and
    the notes of changes as they were. One refresh at a time.
    """
    config = config or PanelConfig()
    if config.min_value != store.min_value:
        raise ValueError(f"the store keeps values above {store.min_value}, the panel wants those above {config.min_value}")
    last = store.last_day()
    if last is None:
        raise PipelineError("there are no prices")
    until = min(datetime.fromisoformat(str(as_of)[:10]), last) if as_of is not None else last
    cache, key = SnapshotCache(store.spark, f"{store.path}/metrics"), json.dumps(dataclasses.asdict(config), sort_keys=True)
    mark, previous, changes = cache.manifest(key), cache.get(key), store.changes()
    taken = set(json.loads(mark.notes)) if mark else set()
    new = {name: oldest for name, oldest in changes.items() if name not in taken}
    since, rows = None, None
    if mark is not None and previous is not None:
        kept = datetime.fromisoformat(mark.evidence_available_at)
        if not new and kept == until:
            return previous, None
        since = first_stale_week(previous, min([kept, until, *(datetime.fromisoformat(x) for x in new.values())]))
        fresh = metrics_from(store, config, previous, since, until.date())
        rows = None if fresh is None else previous.where(F.col("week") < F.lit(since)).unionByName(fresh)
    if rows is None:
        rows = theme_metrics(Panel.of_observed(store.observed(until.date()), config))
        since = None
    notes = json.dumps(sorted(changes))
    cache.put(key, rows, SourceManifest("metrics", f"{store.path}/state", None, datetime.now().isoformat(timespec="seconds"), until.isoformat(), notes=notes))
    out = cache.get(key)
    return out, since or out.agg(F.min("week")).first()[0]


def run_from_store(
    store: ObservationStore,
    as_of: date | str | None = None,
    current: CurrentLeaderConfig | None = None,
    radar: EmergingRadarConfig | None = None,
    hold: HoldCandidateConfig | None = None,
) -> SignalRun:
    """plans.pipeline.run_signal_pipeline over a store: the same lanes, from metrics that are refreshed first. The fingerprint is that of the merged state, so it is the same however rows were cut into batches, and another where a row changes what a run reads."""
    current, radar, hold = current or CurrentLeaderConfig(), radar or EmergingRadarConfig(), hold or HoldCandidateConfig()
    made = {c.panel: refreshed_metrics(store, c.panel, as_of)[0] for c in (current, radar, hold)}
    last = store.last_day()
    until = min(datetime.fromisoformat(str(as_of)[:10]), last) if as_of is not None else last
    day = f"{until:%Y-%m-%d}"
    settings = json.dumps([day, *(dataclasses.asdict(c) for c in (current, radar, hold))], sort_keys=True, default=str)
    return SignalRun(
        day, state_fingerprint(store, day, settings), lanes.current_leader(made[current.panel], current, day), lanes.emerging_radar(made[radar.panel], radar, day), lanes.hold_candidate_12m(made[hold.panel], hold, day)
    )


def state_fingerprint(store: ObservationStore, as_of: str, settings: str = "") -> DataFrame:
    """One row, one hash, of the merged state up to as_of; sums of row hashes, modulo primes, so that no task gathers all of it."""
    rows = merged(store.state(as_of), "week", "upto", "theme", "security")
    text = F.to_json(F.struct(*rows.columns))
    one, two = F.pmod(F.xxhash64(text), F.lit(2_147_483_647)), F.pmod(F.xxhash64(F.lit("b"), text), F.lit(2_147_483_629))
    sums = rows.agg(F.count("*").alias("n"), F.sum(one).alias("a"), F.sum(two).alias("b"))
    return sums.select(F.sha2(F.concat_ws("|", "n", "a", "b", F.lit(settings)), 256).alias("fingerprint"))

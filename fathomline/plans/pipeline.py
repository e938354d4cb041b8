"""The signal pipeline: guards, as-of filter, fingerprint, the three lanes over one panel, and the run's manifest."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import CurrentLeaderConfig, EmergingRadarConfig, HoldCandidateConfig, PanelConfig
from fathomline.operators.metrics import theme_metrics
from fathomline.operators.panel import REQUIRED, Panel, require
from fathomline.plans import lanes

#: Columns that may say when a price was known; the first that there is counts.
AVAILABILITY = ("feature_available_at", "evidence_available_at", "available_at")
DISCLAIMER = "Research signals, not investment advice."


class PipelineError(ValueError):
    """The input has no place in a run: dates that can't be read, nothing known at the as-of date."""


class AvailabilityError(PipelineError):
    """Prices that were known only after their day, or of which nothing says when they were known."""


def _day(prices: DataFrame) -> Column:
    kind = dict(prices.dtypes)["date"]
    return (F.col("date").try_cast("timestamp") if kind == "string" else F.col("date")).cast("timestamp_ntz")


def checked_as_of(prices: DataFrame, as_of: date | str | None = None) -> datetime:
    """The midnight up to which rows count: that of as_of or, without one, of the last date. One pass over the input, which also guards it.

    Raises if a date can't be read, if a price was known at or after the midnight that ends its day, if nothing says when one was known though there is a column for it, or if no row lies at or before that midnight.
    """
    require(prices)
    day = _day(prices)
    limit = F.to_date(F.lit(str(as_of)[:10])).cast("timestamp_ntz") if as_of is not None else None
    checks = [F.count_if(day.isNull()).alias("unread"), F.max(day).cast("date").alias("last"), F.min(day).alias("first")]
    name = next((n for n in AVAILABILITY if n in prices.columns), None)
    if name:
        known = (F.col(name).try_cast("timestamp") if dict(prices.dtypes)[name] == "string" else F.col(name)).cast("timestamp_ntz")
        checks += [F.count_if(known.isNull()).alias("unknown"), F.count_if(known >= F.date_add(day.cast("date"), 1).cast("timestamp_ntz")).alias("late")]
    found = prices.agg(*checks, *([limit.alias("limit")] if limit is not None else [])).first()
    if found["unread"]:
        raise PipelineError(f"{found['unread']} rows have dates that can't be read")
    if name and found["unknown"]:
        raise AvailabilityError(f"{found['unknown']} rows have times in {name} that can't be read")
    if name and found["late"]:
        raise AvailabilityError(f"{found['late']} rows were available only after their date ({name})")
    if found["first"] is None:
        raise PipelineError("there are no prices")
    until = datetime(found["last"].year, found["last"].month, found["last"].day) if as_of is None else found["limit"]
    if until is None:
        raise PipelineError(f"as_of can't be read: {as_of}")
    if found["first"] > until:
        raise PipelineError(f"no price lies at or before {until:%Y-%m-%d}")
    return until


def guard_availability(prices: DataFrame) -> None:
    """Raises if any price was known at or after the midnight that ends its day, or has no time at which it was known."""
    checked_as_of(prices)


def up_to(prices: DataFrame, as_of: datetime | date | str) -> DataFrame:
    """Rows until midnight of as_of, so later hours of that day aren't in."""
    return prices.where(_day(prices) <= F.to_date(F.lit(str(as_of)[:10])).cast("timestamp_ntz"))


def fingerprint(prices: DataFrame, settings: str = "") -> DataFrame:
    """One row, one hash: the same for the same rows in any order, another for other rows or settings.

    Row hashes are summed in two independent ways, modulo primes, so that partial sums meet instead of a sorted list of all rows.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (*REQUIRED, *(n for n in AVAILABILITY if n in prices.columns))]
    text = F.concat_ws("\u0001", *cells)
    one, two = F.pmod(F.xxhash64(text), F.lit(2_147_483_647)), F.pmod(F.xxhash64(F.lit("b"), text), F.lit(2_147_483_629))
    sums = prices.agg(F.count("*").alias("n"), F.sum(one).alias("a"), F.sum(two).alias("b"), F.bit_xor(F.xxhash64(F.lit("c"), text)).alias("c"))
    return sums.select(F.sha2(F.concat_ws("|", "n", "a", "b", "c", F.lit(settings)), 256).alias("fingerprint"))


def latest_cross_section(lane: DataFrame) -> DataFrame:
    """Rows of the last decision date."""
    last = lane.agg(F.max("decision_date").alias("_last"))
    return lane.join(F.broadcast(last), F.col("decision_date") == F.col("_last")).drop("_last")


def status_counts(lane: DataFrame, name: str) -> DataFrame:
    """status and rows of the last cross-section, its date and all its rows. Rows are counted by date and status first, so the lane is planned once and what is compared is small."""
    each = lane.groupBy("decision_date", "status").agg(F.count("*").alias("rows"))
    last = each.agg(F.max(F.struct("decision_date")).alias("_last"), F.collect_list(F.struct("decision_date", "status", "rows")).alias("_each"))
    own = last.select(F.col("_last.decision_date").alias("latest_date"), F.explode("_each").alias("_e")).where("_e.decision_date = latest_date")
    whole = F.sum("_e.rows").over(Window.partitionBy("latest_date")).alias("lane_rows")
    return own.select(F.lit(name).alias("lane"), "_e.status", "_e.rows", "latest_date", whole)


@dataclasses.dataclass
class SignalRun:
    as_of: str
    fingerprint: DataFrame
    current_leader: DataFrame
    emerging_radar: DataFrame
    hold_candidate: DataFrame
    disclaimer: str = DISCLAIMER

    @property
    def lanes(self) -> dict[str, DataFrame]:
        return {"current_leader": self.current_leader, "emerging_radar": self.emerging_radar, "hold_candidate_12m": self.hold_candidate}

    def manifest(self) -> DataFrame:
        """For each lane and status: rows in the latest cross-section, its date, and the lane's rows in it."""
        frames = [status_counts(rows, name) for name, rows in self.lanes.items()]
        return frames[0].unionByName(frames[1]).unionByName(frames[2])


def run_signal_pipeline(
    prices: DataFrame,
    as_of: date | str | None = None,
    current: CurrentLeaderConfig | None = None,
    radar: EmergingRadarConfig | None = None,
    hold: HoldCandidateConfig | None = None,
    row_order: str | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> SignalRun:
    """Checks the input at once (checked_as_of) and leaves all else lazy. Lanes whose settings make the same panel share its metrics, which Spark then plans once; any others have a panel of their own. keep: what is done with a metrics table
    (one row for each theme and week) before lanes read it, such as sources.shared.written, where several results of a run are wanted."""
    until = checked_as_of(prices, as_of)
    own = up_to(prices, until)
    current, radar, hold = current or CurrentLeaderConfig(), radar or EmergingRadarConfig(), hold or HoldCandidateConfig()
    settings = json.dumps([str(until), *(dataclasses.asdict(c) for c in (current, radar, hold))], sort_keys=True, default=str)
    made: dict[PanelConfig, DataFrame] = {}
    for c in (current, radar, hold):
        if c.panel not in made:
            made[c.panel] = (keep or (lambda x: x))(theme_metrics(Panel(own, c.panel, row_order)))
    day = f"{until:%Y-%m-%d}"
    return SignalRun(
        day, fingerprint(own, settings), lanes.current_leader(made[current.panel], current, day), lanes.emerging_radar(made[radar.panel], radar, day), lanes.hold_candidate_12m(made[hold.panel], hold, day)
    )

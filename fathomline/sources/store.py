"""A store of price observations that grows by batches and is read pruned.

What it keeps is the mergeable state of the weekly observations, not the rows: for each week, day of knowledge, theme and security the last value, the first sessions and the latest time. All of these are maxima and minima,
so batches may come in any order, late or twice, and state plus batch is the state of all rows. The table is partitioned by the month of a week and bucketed by theme and security: as-of days and ranges prune partitions,
and neither the weekly aggregation nor a member's windows need an exchange.

    store = ObservationStore(spark, "s3a://bucket/prices")
    store.append(batch)                                       # date, theme, security, value
    panel = Panel.of_observed(store.observed("2024-03-29"))   # the same tables as from all rows
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.panel import normalised
from fathomline.sources import files

COLUMNS = "week date, upto date, theme string, security string, last struct<date: timestamp_ntz, row_order: bigint, value: double>, late_session timestamp_ntz, session timestamp_ntz, latest timestamp_ntz, period date"
KEYS = ("week", "upto", "theme", "security")


def period_of(week: Column) -> Column:
    """The partition of a week: the first day of its month."""
    return F.trunc(week, "month")


def merged(state: DataFrame, *keys: str) -> DataFrame:
    """States of the same keys as one."""
    return state.groupBy(*keys).agg(
        F.max_by("last", F.col("last")).alias("last"), F.min("late_session").alias("late_session"), F.min("session").alias("session"), F.max("latest").alias("latest")
    )


def state_of(rows: DataFrame, min_value: float = 0.0) -> DataFrame:
    """The state of normalised rows. upto is the first midnight at or after a row, so that a run as of a day takes the rows whose upto isn't after it."""
    midnight = F.to_date("date").cast("timestamp_ntz")
    upto = F.date_add(F.to_date("date"), F.when(F.col("date") > midnight, 1).otherwise(0))
    late = F.col("date") > F.col("week").cast("timestamp_ntz")
    last = F.when(F.col("value") > min_value, F.struct("date", "row_order", "value"))
    each = rows.withColumns({"upto": upto, "last": last, "late_session": F.when(late, F.col("date")), "session": F.when(~late, F.col("date")), "latest": F.col("date")})
    return merged(each, *KEYS)


class ObservationStore:
    """One table under a folder that driver and executors share; buckets and min_value are fixed when it is made, and a later session opens it as it is.

    A batch is guarded before it is written. An append that fails may be repeated, since merging the same state twice changes nothing; a reader may see part of a batch that is being written, as of any Parquet folder.
    Appends add a file for each bucket and month that they touch; compact() makes one of them again. Rows can't be taken back: a correction is a row of the same time with a higher row_order.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, min_value: float = 0.0) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([(buckets, float(min_value))], "buckets int, min_value double").coalesce(1).write.mode("ignore").json(f"{self.path}/settings")
        kept = spark.read.schema("buckets int, min_value double").json(f"{self.path}/settings").first()
        self.buckets, self.min_value = kept["buckets"], kept["min_value"]
        if files.read_text(spark, f"{self.path}/current") is None:
            self._point_to("state-first")
        self.table = self._open(self._version())

    def _version(self) -> str:
        """The folder of the state that counts. compact() writes another one and names it last."""
        return f"{self.path}/{files.read_text(self.spark, f'{self.path}/current')}"

    def _point_to(self, name: str) -> None:
        pointer = f"{self.path}/pointer-{uuid.uuid4().hex}"
        files.write_text(self.spark, pointer, name)
        files.replace(self.spark, pointer, f"{self.path}/current")

    def _open(self, location: str) -> str:
        name = "observations_" + hashlib.sha256(location.encode()).hexdigest()[:16]
        system, own = files.at(self.spark, location)
        system.mkdirs(own)
        self.spark.sql(f"create table if not exists {name} ({COLUMNS}) using parquet partitioned by (period) clustered by (theme, security) into {self.buckets} buckets location '{location}'")
        self.spark.catalog.recoverPartitions(name)
        return name

    def append(self, prices: DataFrame, row_order: str | None = None) -> str | None:
        """Adds a batch and notes its oldest time, from which runs have to be made again (refreshed_metrics); that time, None for a batch without rows. The note is written first, so that no change goes unseen."""
        from fathomline.plans.pipeline import checked_as_of  # what a run refuses, a store refuses

        if prices.isEmpty():
            return None
        checked_as_of(prices)
        rows = normalised(prices, row_order)
        oldest = rows.agg(F.min("date").cast("string").alias("oldest")).first()["oldest"]
        if oldest is None:
            return None
        self.spark.createDataFrame([(oldest,)], "oldest string").coalesce(1).write.json(f"{self.path}/changes/{uuid.uuid4().hex}")
        self._insert(state_of(rows, self.min_value), self.table)
        return oldest

    def _insert(self, state: DataFrame, table: str) -> None:
        own = state.withColumn("period", period_of(F.col("week"))).repartition(self.buckets, "theme", "security")
        own.select(*self.spark.table(table).columns).write.insertInto(table)

    def state(self, as_of: date | str | None = None, first: date | str | None = None, last: date | str | None = None) -> DataFrame:
        """State of the rows up to the midnight of as_of, in weeks from first to last; whole partitions that can't have any aren't read. Not merged over batches."""
        rows = self.spark.table(self.table)
        day = lambda x: F.to_date(F.lit(str(x)[:10]))
        if as_of is not None:
            friday = F.next_day(F.date_sub(day(as_of), 1), "FRI")
            rows = rows.where((F.col("period") <= period_of(friday)) & (F.col("upto") <= day(as_of)))
        if first is not None:
            rows = rows.where((F.col("period") >= period_of(day(first))) & (F.col("week") >= day(first)))
        if last is not None:
            rows = rows.where((F.col("period") <= period_of(day(last))) & (F.col("week") <= day(last)))
        return rows

    def observed(self, as_of: date | str | None = None, first: date | str | None = None, last: date | str | None = None) -> DataFrame:
        """Weekly observations, as operators.panel.weekly_observations makes them of all rows."""
        return merged(self.state(as_of, first, last), "week", "theme", "security").select("week", "theme", "security", F.col("last.value").alias("price"), "late_session", "session")

    def members(self, before: date | str, as_of: date | str | None = None) -> DataFrame:
        """theme, security and whether it had a price, of all that are named in weeks before a day."""
        rows = self.state(as_of).where((F.col("period") <= period_of(F.to_date(F.lit(str(before)[:10])))) & (F.col("week") < F.to_date(F.lit(str(before)[:10]))))
        return rows.groupBy("theme", "security").agg(F.max(F.col("last").isNotNull()).alias("seen"))

    def last_day(self) -> datetime | None:
        """The midnight of the last row's day: up to it a run without an as-of day counts rows."""
        found = self.spark.table(self.table).agg(F.max("latest").cast("date").alias("day")).first()["day"]
        return datetime(found.year, found.month, found.day) if found else None

    def changes(self) -> dict[str, str]:
        """The notes of appends that no refreshed run has taken up yet: folder and oldest time."""
        names = files.folders(self.spark, f"{self.path}/changes")
        if not names:
            return {}
        rows = self.spark.read.schema("oldest string").json(names).select(F.regexp_extract(F.input_file_name(), "/changes/([0-9a-f]+)/", 1).alias("name"), "oldest").collect()
        return {r["name"]: r["oldest"] for r in rows}

    def forget(self, changes: dict[str, str]) -> None:
        """Removes notes that a run has taken up."""
        for name in changes:
            files.remove(self.spark, f"{self.path}/changes/{name}")

    def compact(self) -> None:
        """Merges what batches have left, into a file for each bucket and month, in a folder of its own that one renamed file then puts in place of the old one. Nothing may be appended meanwhile; a compaction that is lost changes nothing, and readers keep the old folder until clean()."""
        name = f"state-{uuid.uuid4().hex}"
        table = self._open(f"{self.path}/{name}")
        self._insert(merged(self.spark.table(self.table), *KEYS), table)
        self._point_to(name)
        self.table = table

    def clean(self) -> int:
        """Removes states that don't count any more, when nothing reads or writes them; their number."""
        now = self._version().rpartition("/")[2]
        gone = [f for f in files.folders(self.spark, self.path) if f.rpartition("/")[2].startswith("state-") and f.rpartition("/")[2] != now]
        for folder in gone:
            files.remove(self.spark, folder)
        return len(gone)

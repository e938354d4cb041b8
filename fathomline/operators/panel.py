"""From a tidy price panel (date, theme, security, value) to dense weekly tables.

Weeks end on Fridays. Every table is long and lazy; a grid of all weeks makes ROWS frames count weeks. Three tables come out:

    members     week, theme, security, price, seen, ret, r4 .. r52       one row for each member and week
    calendar    week, b_price, b_ret, b4 .. b52, effective_date          one row for each week
    themes      week, theme, members_seen, members_valid, participation, theme_return
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import PanelConfig
from fathomline.functions.expr import WINDOWS, compounded_all, number, so_far, week_of

REQUIRED = ("date", "theme", "security", "value")


def require(data: DataFrame, names: tuple[str, ...] = REQUIRED) -> None:
    missing = [n for n in names if n not in data.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def normalised(data: DataFrame, row_order: str | None = None) -> DataFrame:
    """date (timestamp without zone), theme, security (upper case), value, week, row_order. Rows without a date or with a blank name go; values that are no
    numbers become null and stay, since their dates are sessions. row_order settles several values at one time; without it the larger value is the later."""
    require(data)
    order = F.col(row_order).cast("bigint") if row_order else F.lit(0).cast("bigint")
    rows = data.select(
        F.col("date").cast("string").try_cast("timestamp_ntz").alias("date") if dict(data.dtypes)["date"] == "string" else F.col("date").cast("timestamp_ntz").alias("date"),
        F.trim(F.col("theme").cast("string")).alias("theme"),
        F.upper(F.trim(F.col("security").cast("string"))).alias("security"),
        number(F.col("value")).alias("value"),
        order.alias("row_order"),
    )
    rows = rows.where(F.col("date").isNotNull() & (F.length("theme") > 0) & (F.length("security") > 0))
    return rows.withColumn("week", week_of(F.col("date")))


def weekly_observations(rows: DataFrame, min_value: float = 0.0) -> DataFrame:
    """One row for each week, theme and security that has any row: price (the last value above min_value, or null), and the first session of the week after Friday 00:00
    and up to it. All else is made of this table, so the input is read and shuffled once."""
    at, late = F.struct("date", "row_order", "value"), F.col("date") > F.col("week").cast("timestamp_ntz")
    return rows.groupBy("week", "theme", "security").agg(
        F.max_by("value", F.when(F.col("value") > min_value, at)).alias("price"), F.min(F.when(late, F.col("date"))).alias("late_session"), F.min(F.when(~late, F.col("date"))).alias("session")
    )


def last_of_week(rows: DataFrame, min_value: float = 0.0) -> DataFrame:
    """week, theme, security, price: the last value above min_value of each week."""
    return weekly_observations(rows, min_value).where("price is not null").select("week", "theme", "security", "price")


def weeks(rows: DataFrame) -> DataFrame:
    """Every week from the first to the last, without gaps."""
    ends = rows.agg(F.min("week").alias("first"), F.max("week").alias("last")).where("first is not null")
    return ends.select(F.explode(F.sequence("first", "last", F.expr("interval 7 days"))).alias("week"))


def by_week(observed: DataFrame, benchmark: str) -> DataFrame:
    """One row for each week that has any: the benchmark's price (the median over the themes that hold it), the first session after Friday 00:00 and the first one up to it."""
    return observed.groupBy("week").agg(F.median(F.when(F.col("security") == benchmark, F.col("price"))).alias("b_price"), F.min("late_session").alias("late"), F.min("session").alias("session"))


def calendar_panel(weekly: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One row for each week from the first to the last: the benchmark's price, return and windows, and effective_date, the first session after Friday 00:00 or, where there is none, the next business day (the Monday).

    Its windows run over one row a week, in one task. Later sessions are looked for in descending order, in a frame that only grows.
    """
    dense = weeks(weekly).join(weekly, "week", "left")
    by = Window.partitionBy(F.lit(0)).orderBy("week")
    onward = Window.partitionBy(F.lit(0)).orderBy(F.desc("week")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dense.select("week", "b_price", (F.col("b_price") / F.lag("b_price").over(by) - 1.0).alias("b_ret"), F.least("late", F.lead("session").over(by)).alias("_session"))
    return rows.select("week", "b_price", "b_ret", *compounded_all("b_ret", by, windows, "b"), F.coalesce(F.min("_session").over(onward), F.date_add("week", 3).cast("timestamp_ntz")).alias("effective_date"))


def densified(observed: DataFrame, benchmark: str, weekly: DataFrame | None = None) -> DataFrame:
    """A row for each member ever named and each week; price is null where there is none. Each member makes its own weeks from the two ends of the calendar,
    one row that every task gets."""
    ends = (observed if weekly is None else weekly).agg(F.min("week").alias("_first"), F.max("week").alias("_last"))
    own = observed.where(F.col("security") != benchmark)
    grid = own.select("theme", "security").distinct().join(F.broadcast(ends), F.lit(True)).select("theme", "security", F.explode(F.sequence("_first", "_last", F.expr("interval 7 days"))).alias("week"))
    return grid.join(own.select("week", "theme", "security", "price"), ["week", "theme", "security"], "left")


def member_panel(observed: DataFrame, benchmark: str, windows: tuple[int, ...] = WINDOWS, weekly: DataFrame | None = None) -> DataFrame:
    by = Window.partitionBy("theme", "security").orderBy("week")
    grid = densified(observed, benchmark, weekly)
    seen = F.max(F.col("price").isNotNull()).over(so_far(by))
    known = grid.select("week", "theme", "security", "price", seen.alias("seen"), (F.col("price") / F.lag("price").over(by) - 1.0).alias("ret"))
    return known.select("*", *compounded_all("ret", by, windows, "r"))


def member_sums(members: DataFrame, calendar: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One row for each theme and week: members seen and valid, mean return, breadth, concentration and top share for each window. One shuffle, with partial sums."""
    rows = members.join(F.broadcast(calendar), "week", "left")
    sums = ["sum(int(seen)) as members_seen", "count(ret) as members_valid", "avg(ret) as _mean"]
    for w in windows:
        gain = f"case when r{w} is not null then greatest(r{w}, 0D) end"
        sums += [f"count_if(r{w} is not null and b{w} is not null) as _valid{w}", f"count_if(r{w} > b{w}) as _winners{w}", f"count(r{w}) as _n{w}", f"sum({gain}) as _gain{w}", f"sum(({gain}) * ({gain})) as _gain2{w}", f"max({gain}) as _top{w}"]
    each = rows.groupBy("week", "theme").agg(*map(F.expr, sums))
    out = ["week", "theme", "members_seen", "members_valid", "try_divide(double(members_valid), nullif(members_seen, 0)) as participation", "_mean"]
    for w in windows:
        flat = f"case when _n{w} = 0 then null when _gain{w} <= 0 then 0D else "
        out += [
            f"try_divide(double(_winners{w}), nullif(_valid{w}, 0)) as breadth_{w}w",
            f"{flat} try_divide(_gain2{w}, _gain{w} * _gain{w}) end as concentration_{w}w",
            f"{flat} try_divide(_top{w}, _gain{w}) end as top_share_{w}w",
        ]
    return each.selectExpr(*out)


def theme_panel(sums: DataFrame, min_participation: float, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Adds theme_return (the mean, where enough of the known members have one), its windows t4 .. t52, theme_index and history_weeks."""
    by = Window.partitionBy("theme").orderBy("week")
    enough = F.expr(f"case when members_valid >= greatest(1D, double(ceil(members_seen * {float(min_participation)}D))) then _mean end")
    own = sums.withColumn("theme_return", enough).drop("_mean")
    growth = F.product(F.lit(1.0) + F.col("theme_return")).over(so_far(by))
    return own.select(
        "*",
        *compounded_all("theme_return", by, windows, "t"),
        F.when(F.col("theme_return").isNotNull(), 100.0 * growth).alias("theme_index"),
        F.expr("double(count(theme_return) over (partition by theme order by week rows between unbounded preceding and current row)) as history_weeks"),
        F.expr("case when count(theme_return) over y = 26 then stddev_samp(theme_return) over y * sqrt(52D) end as annualized_volatility_26w".replace("over y", "over (partition by theme order by week rows between 25 preceding and current row)")),
    )


class Panel:
    """The tables of one input, built lazily. All of them read the weekly observations: within a query Spark makes these once and reuses their exchange. Someone who runs many queries on one panel
    may have them kept (keep=True, made again where an executor is lost) until release()."""

    def __init__(self, data: DataFrame, config: PanelConfig | None = None, row_order: str | None = None, keep: bool = False) -> None:
        self.config = config or PanelConfig()
        self.rows = normalised(data, row_order)
        self.observed = weekly_observations(self.rows, self.config.min_value)
        if keep:
            self.observed = self.observed.persist()

    @classmethod
    def of_observed(cls, observed: DataFrame, config: PanelConfig | None = None) -> Panel:
        """Of weekly observations that are there already, such as a store's; their values must lie above config.min_value."""
        own = cls.__new__(cls)
        own.config, own.rows, own.observed = config or PanelConfig(), None, observed
        return own

    @cached_property
    def weekly(self) -> DataFrame:
        return by_week(self.observed, self.config.benchmark)

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar_panel(self.weekly)

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.calendar.drop("effective_date")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.calendar.select("week", "effective_date")

    @cached_property
    def members(self) -> DataFrame:
        return member_panel(self.observed, self.config.benchmark, weekly=self.weekly)

    @cached_property
    def sums(self) -> DataFrame:
        return member_sums(self.members, self.benchmark)

    @cached_property
    def themes(self) -> DataFrame:
        return theme_panel(self.sums, self.config.min_participation)

    def release(self) -> None:
        self.observed.unpersist()

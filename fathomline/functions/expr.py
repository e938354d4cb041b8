"""Column expressions that the operators share.

Missing numbers are NULL, never NaN: every comparison that decides something goes through gate(), so that a missing input fails it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from fathomline.config import WINDOWS  # noqa: F401  rolling windows in weeks


def gate(*conditions: Column) -> Column:
    """All conditions hold; a null one doesn't."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


def number(column: Column) -> Column:
    """A double; what can't be read as one, NaN and infinities are null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def week_of(date: Column) -> Column:
    """The Friday that ends the date's week."""
    return F.next_day(F.date_sub(F.to_date(date), 1), "FRI")


def before_now(spec: WindowSpec, rows: int) -> WindowSpec:
    return spec.rowsBetween(1 - rows, Window.currentRow)


def so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def compounded_all(returns: str, spec: WindowSpec, windows: tuple[int, ...], prefix: str) -> list[Column]:
    """For each window, as <prefix>N, the compounded return of exactly N rows, all of them observed."""
    seen, growth, one = F.count(returns), F.product(F.lit(1.0) + F.col(returns)), F.lit(1.0)
    out = []
    for n in windows:
        over = before_now(spec, n)
        out.append(F.when(seen.over(over) == n, growth.over(over) - one).alias(f"{prefix}{n}"))
    return out


def percentile_rank(value: str, *by: str) -> Column:
    """Average-tie rank within the groups of `by` as a share of the values that there are; nulls have none. Both parts read one window order, so Spark sorts once; a group is one task, so wide ones want operators.ranks.with_average_rank."""
    order = f"partition by {', '.join(by)} order by {value} asc nulls last"
    rank = f"case when {value} is not null then rank() over ({order}) + (count({value}) over ({order} range between current row and current row) - 1) / 2D end"
    return F.expr(f"{rank} / count({value}) over ({order} rows between unbounded preceding and unbounded following)")


def clipped(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Between low and high; null stays null."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def worst_fall(prices: Column) -> Column:
    """Deepest fall of an array below its own running peak (0 or less)."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, p: Column) -> Column:
        peak = F.greatest(a["peak"], p)
        return F.struct(peak.alias("peak"), F.least(a["worst"], p / peak - 1.0).alias("worst"))

    return F.when(F.size(prices) > 0, F.aggregate(prices, start, step, lambda a: a["worst"]))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where one side doesn't vary (corr() would divide by zero)."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def warnings_text(*flags: tuple[Column, str]) -> Column:
    """The names of the flags that hold, in order, joined by '; '."""
    named = F.array(*(F.when(gate(c), F.lit(name)) for c, name in flags))
    return F.array_join(F.array_distinct(F.filter(named, lambda x: x.isNotNull())), "; ")


def choose(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The first case that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(gate(condition), F.lit(name)).otherwise(out)
    return out

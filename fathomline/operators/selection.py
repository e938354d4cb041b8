"""Exact order statistics of columns of any size, without gathering or sorting them: a histogram of the range that holds the wanted value, then one of the bin that holds it, until a bin is one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass: what reaches the driver is one row for each.
BINS = 4096


def _kth(values: DataFrame, column: str, ranks: list[int], least: float, most: float) -> list[float]:
    """The values of those ranks (from 0) of a column without nulls, which lie from least to most."""
    found: dict[int, float] = {}
    # what is open: rank within a range of values, and the range
    open_ = {rank: (rank, least, most) for rank in set(ranks)}
    while open_:
        for rank, (_, low, high) in list(open_.items()):
            if low == high:
                found[rank] = low
                del open_[rank]
        spans = sorted({(low, high) for _, low, high in open_.values()})
        if not spans:
            break
        x, which, place = F.col(column), F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (low, high) in enumerate(spans):
            inside = x.between(low, high)
            which = F.when(inside, i).otherwise(which)
            share = (x / 2 - low / 2) / (high / 2 - low / 2)  # halves, so that no difference overflows
            place = F.when(inside, F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")).otherwise(place)
        bins = values.select(x.alias("x"), which.alias("span"), place.alias("bin")).where("span is not null").groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for rank, (left, low, high) in list(open_.items()):
            own = sorted((r["bin"], r["n"], r["low"], r["high"]) for r in bins if r["span"] == spans.index((low, high)))
            for _, n, low_, high_ in own:
                if left < n:
                    open_[rank] = (left, low_, high_)
                    break
                left -= n
    return [found[r] for r in ranks]


def exact_medians(values: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each numeric column, the mean of the middle two of an even number; null for a column without values. Nulls don't count; NaN isn't a number here and doesn't either.

    values is read once for the ranges, and for each column once for each pass; a pass narrows the range to a BINS-th at least, or to one value, so two or three are usual. Write values first if they are dear to make.
    """
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    values = values.select(*(number[c].alias(c) for c in columns))
    sizes = values.agg(*(x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")))).first()
    out: dict[str, float | None] = {}
    for c in columns:
        n = sizes[f"n_{c}"]
        if not n:
            out[c] = None
            continue
        a, b = _kth(values.where(F.col(c).isNotNull()), c, [(n - 1) // 2, n // 2], sizes[f"low_{c}"], sizes[f"high_{c}"])
        out[c] = a if a == b else a + (b - a) / 2
    return out

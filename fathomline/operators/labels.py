"""What happened after a decision: forward returns, leader flags, move classes.

A series is a table (theme, ts, price, b_price); b_price may be missing as a column or null where the benchmark has no price. Rows with a null in either are no observations.
The entry is the next observation after the decision; the exit the first one at least so many weeks after the entry, by a RANGE frame that gaps don't mislead. Frames grow from one end only (later rows are reached in descending
order), so a series takes time in proportion to its rows, however dense they are; what lies between an entry and its exit is summed up by paths(), without a list of rows for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import EpisodeConfig
from fathomline.functions.expr import gate, percentile_rank

HORIZONS = (13, 26, 52)
DAY = 86400


def observed(series: DataFrame, by: str = "theme") -> DataFrame:
    """Rows with all prices, with the place and the second of each and the number of rows from which exits are found."""
    prices = [c for c in ("price", "b_price") if c in series.columns]
    rows = series.dropna(subset=["ts", *prices])
    order = Window.partitionBy(by).orderBy("ts")
    return rows.withColumns({"pos": F.row_number().over(order) - 1, "_s": F.unix_seconds(F.col("ts").cast("timestamp"))})


def first_from(value: Column, weeks: int, by: str) -> Column:
    """value of the first row at least so many weeks later. In descending order that is the last of a frame that only grows."""
    return F.last(value).over(Window.partitionBy(by).orderBy(F.col("_s").desc()).rangeBetween(Window.unboundedPreceding, -7 * weeks * DAY))


def forward(rows: DataFrame, horizons: Sequence[int], by: str = "theme", next_session: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Adds entry and exit_H: structs (ts, price, b_price, pos and the columns of carry) of the entry and of each horizon's exit, null where the series ends before."""
    names = [c for c in ("ts", "price", "b_price", "parent_price", "pos", *carry) if c in rows.columns]
    here = F.struct(*names)
    exits = {f"_exit{h}": first_from(here, h, by) for h in horizons}
    rows = rows.withColumns({"_here": here, **exits})
    order = Window.partitionBy(by).orderBy("ts")
    later = (lambda c: F.lead(c).over(order)) if next_session else F.col
    return rows.withColumns({"entry": later("_here"), **{f"exit_{h}": later(f"_exit{h}") for h in horizons}}).drop("_here", *exits)


def paths(rows: DataFrame, weeks: int, by: str, name: str, sums: dict[str, Column], falls: bool = False) -> DataFrame:
    """Adds the structs <name>_from and <name>_to, for stretches of rows that end before the first row at least so many weeks later.

    Time is cut into blocks of that length. Such a stretch begins in one block and ends in it, at its last row, or in the next: it is what follows in the first (<name>_from: block and sums from a row to its block's end) and, if the row
    before the stretch's end lies in another block, what precedes in the second (<name>_to of the end: block and sums of its block up to the row before the end). sums: name -> value of which the largest is wanted; falls: also the deepest fall of price below its own running peak, with
    highest and lowest price. Both are windows over one block each, so no row gets a list and each row is read a fixed number of times.
    """
    block = f"_{name}_block"
    rows = rows.withColumn(block, F.floor(F.col("_s") / (7 * weeks * DAY)))
    at = Window.partitionBy(by, block)
    ahead, behind = at.orderBy(F.col("pos").desc()), at.orderBy("pos")
    grown = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = {k: (F.max(v).over(grown(ahead)), F.max(v).over(grown(behind))) for k, v in sums.items()}
    if falls:
        both |= {"top": tuple(F.max("price").over(grown(w)) for w in (ahead, behind)), "low": tuple(F.min("price").over(grown(w)) for w in (ahead, behind))}
        rows = rows.withColumns({f"_{name}_l": both["low"][0], f"_{name}_t": both["top"][1]})
        fall = (F.try_divide(F.col(f"_{name}_l"), F.col("price")), F.try_divide(F.col("price"), F.col(f"_{name}_t")))
        both["fall"] = tuple(F.min(x - 1.0).over(grown(w)) for x, w in zip(fall, (ahead, behind), strict=True))
    rows = rows.withColumns({f"{name}_from": F.struct(F.col(block).alias("block"), *(x[0].alias(k) for k, x in both.items())), f"_{name}_up": F.struct(F.col(block).alias("block"), *(x[1].alias(k) for k, x in both.items()))})
    return rows.withColumn(f"{name}_to", F.lag(f"_{name}_up").over(Window.partitionBy(by).orderBy("ts"))).drop(block, f"_{name}_up", f"_{name}_l", f"_{name}_t")


def deepest_fall(begin: Column, end: Column, last: Column) -> Column:
    """The deepest fall of the rows of a stretch (begin: its first row's <name>_from, end: its end's <name>_to) and of the price `last` that ends it."""
    own = F.least(F.lit(0.0), begin["fall"], F.try_divide(last, begin["top"]) - 1.0)
    more = F.least(end["fall"], F.try_divide(end["low"], begin["top"]) - 1.0, F.try_divide(last, end["top"]) - 1.0)
    return F.when(end["block"] == begin["block"], own).otherwise(F.least(own, more))


def future_labels(
    series: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    next_session: bool = True,
    absolute_threshold: float | None = 0.30,
    excess_threshold: float | None = 0.20,
    by: str = "theme",
    drawdown: bool = True,
) -> DataFrame:
    """One row for each observation (decision_at) and theme, with columns for each horizon H:

    entry_at_Hw, exit_at_Hw, label_available_at_Hw, future_Hw_return, future_Hw_benchmark_return, future_Hw_excess_return, future_Hw_max_relative_drawdown,
    label_Hw (null until the horizon has passed). Without a benchmark the excess is the return. series may have a column parent_price: then also future_Hw_parent_sector_excess_return
    (a missing parent price doesn't drop the row).
    """
    if any(h <= 0 for h in horizons):
        raise ValueError("horizons must be positive")
    rows, carry = observed(series, by), []
    if drawdown:
        for h in horizons:
            rows = paths(rows, h, by, f"path{h}", {}, falls=True)
            carry += [f"path{h}_from", f"path{h}_to"]
    rows = forward(rows, horizons, by, next_session, carry)
    has_benchmark = "b_price" in series.columns
    out: list[Column] = [F.col("ts").alias("decision_at"), F.col(by)]
    for h in horizons:
        entry, end, s = F.col("entry"), F.col(f"exit_{h}"), f"{h}w"
        done = end.isNotNull()
        gain = F.when(done & (entry["price"] != 0), F.try_divide(end["price"], entry["price"]) - 1.0)
        b_gain = F.when(done & (entry["b_price"] != 0), F.try_divide(end["b_price"], entry["b_price"]) - 1.0) if has_benchmark else F.lit(None).cast("double")
        excess = gain - b_gain if has_benchmark else gain
        label = F.lit(True)
        if absolute_threshold is not None:
            label = label & (gain >= absolute_threshold)
        if excess_threshold is not None:
            label = label & (excess >= excess_threshold)
        known = gain.isNotNull() & (excess.isNotNull() if excess_threshold is not None else F.lit(True))
        out += [
            F.when(entry.isNotNull(), entry["ts"]).alias(f"entry_at_{s}"),
            *(end["ts"].alias(f"{n}_{s}") for n in ("exit_at", "label_available_at", "maturity_at", "label_end")),
            gain.alias(f"future_{s}_return"),
            b_gain.alias(f"future_{s}_benchmark_return"),
            excess.alias(f"future_{s}_excess_return"),
            F.when(known, label).alias(f"label_{s}"),
        ]
        if drawdown:
            out.append(F.when(done & (entry["price"] != 0), deepest_fall(entry[f"path{h}_from"], end[f"path{h}_to"], end["price"])).alias(f"future_{s}_max_relative_drawdown"))
        if "parent_price" in series.columns:
            parent = F.when(entry["parent_price"] != 0, F.try_divide(end["parent_price"], entry["parent_price"]) - 1.0)
            out.append((gain - parent).alias(f"future_{s}_parent_sector_excess_return"))
        if h == 52:
            out.append(gain.alias("exact_52w_hold_return"))
    return rows.select(*out)


def future_panel_labels(series: DataFrame, horizons: Sequence[int] = HORIZONS, next_session: bool = True) -> DataFrame:
    """future_labels without thresholds, with the average-tie rank of each forward return among themes at a decision, and leader_Hw: ahead of the benchmark and in the top fifth."""
    rows = future_labels(series, horizons, next_session, None, None)
    rows = rows.select("*", *(percentile_rank(f"future_{h}w_return", "decision_at").alias(f"future_{h}w_return_rank") for h in horizons))
    return rows.select("*", *(gate(F.col(f"future_{h}w_excess_return") > 0, F.col(f"future_{h}w_return_rank") >= 0.80).alias(f"leader_{h}w") for h in horizons))


def classify_moves(moves: DataFrame, config: EpisodeConfig | None = None) -> DataFrame:
    """Adds excess_return, the gates' results, major_surge, explosive and label to rows of (theme_return, spy_return) and, where there are such columns,
    breadth_up, breadth_beat_spy, active_names, theme_rank_percentile, top_decile.

    A missing excess fails; upward breadth and names must be there (unless the configuration lets breadth go); the others count only where they are given.
    """
    c = config or EpisodeConfig()
    have = lambda n, kind="double": F.col(n) if n in moves.columns else F.lit(None).cast(kind)
    rank, decile = have("theme_rank_percentile"), have("top_decile", "boolean")
    up_ok = gate(have("breadth_up") >= c.min_breadth) if c.require_breadth else F.lit(True)
    beat = have("breadth_beat_spy")
    beat_ok = F.coalesce(beat >= c.min_beat_breadth, F.lit(True)) if c.require_breadth else F.lit(True)
    rows = moves.withColumns(
        {
            "excess_return": F.col("theme_return") - F.col("spy_return"),
            "breadth_up_ok": up_ok,
            "breadth_beat_spy_ok": beat_ok,
            "breadth_ok": up_ok & beat_ok,
            "min_names_ok": gate(have("active_names", "bigint") >= c.min_names) if c.require_min_names else F.lit(True),
            "top_decile_ok": F.coalesce(decile, rank >= c.min_rank, F.lit(True)),
        }
    )
    rows = rows.withColumn(
        "major_surge", gate(F.col("theme_return") >= c.major_return, F.col("excess_return") >= c.major_excess, F.col("breadth_ok"), F.col("min_names_ok"), F.col("top_decile_ok"))
    )
    rows = rows.withColumn("explosive", gate(F.col("major_surge"), F.col("theme_return") >= c.explosive_return))
    return rows.withColumn("label", F.when(F.col("explosive"), "explosive").when(F.col("major_surge"), "major_surge").otherwise("none"))

"""Episodes: onset, first crossing and peak of large moves, their labels, and their merge into episodes that don't overlap.

The onset of a row is the first lowest price of the rows from onset_weeks before it; a row crosses when its price has gained major_return on that low. Neither depends on the
decision, so a decision's crossing is the next crossing row from its entry on, if it lies within the horizon. The peak of a row, the first highest price up to its own horizon, doesn't either: it is made of two windows
over blocks of time (labels.paths). Only crossings in the last horizon of a series, whose own horizon isn't over, take a list of the rows after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import EpisodeConfig
from fathomline.operators.asof import first_at_or_after
from fathomline.operators.labels import classify_moves, first_from, observed, paths
from fathomline.sources.shared import written


def measured(series: DataFrame, config: EpisodeConfig | None = None, by: str = "theme") -> DataFrame:
    """One row for each observation: decision_at, entry, onset, crossing and end as structs (pos, ts, price, b_price), the returns between them, matured."""
    c = config or EpisodeConfig()
    rows = observed(series, by)
    if "b_price" not in rows.columns:
        rows = rows.withColumn("b_price", F.lit(None).cast("double"))
    order = Window.partitionBy(by).orderBy("ts")
    descending = Window.partitionBy(by).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("pos", "ts", "price", "b_price")
    first_best = lambda p: F.struct(p("price").alias("price"), (-p("pos")).alias("back"), p("ts").alias("ts"), p("b_price").alias("b_price"))  # noqa: E731  of equal prices the first is the largest
    rows = paths(rows, c.horizon_weeks, by, "peak", {"best": first_best(F.col)})
    low = F.min(F.struct("price", "pos", "ts", "b_price")).over(order.rowsBetween(-c.onset_weeks, Window.currentRow))
    limit = first_from(F.struct("pos", "ts", "price", "b_price", "peak_to"), c.horizon_weeks, by)
    rows = rows.withColumns({"_here": here, "_low": low, "_limit": limit})
    own, to = F.col("peak_from"), F.col("_limit.peak_to")
    top = F.greatest(own["best"], F.when(to["block"] != own["block"], to["best"]), first_best(lambda n: F.col(f"_limit.{n}")))
    rows = rows.withColumn("_top", F.when(F.col("_limit").isNotNull(), top))
    crosses = F.coalesce((F.col("_low.price") > 0) & (F.try_divide(F.col("price"), F.col("_low.price")) - 1.0 >= c.major_return), F.lit(False))
    rows = rows.withColumn("_cross", F.when(crosses, F.struct("pos", F.col("_here").alias("at"), F.col("_low").alias("low"), F.col("_top").alias("top"))))
    rows = rows.withColumn("_next", F.last("_cross", ignorenulls=True).over(descending))
    open_ended = rows.where("_limit is null").select(by, "pos", "_cross", first_best(F.col).alias("_best"))
    open_ended = open_ended.withColumn("_after", F.collect_list("_best").over(descending)).where("_cross is not null").select(F.col(by).alias("_by"), F.col("pos").alias("_from"), "_after")
    later = (lambda n: F.lead(n).over(order)) if c.next_session else F.col
    rows = rows.withColumns({"entry": later("_here"), "_terminal": later("_limit"), "_ahead": later("_next"), "_entry_top": later("_top")})
    rows = rows.withColumn("matured", F.col("_terminal").isNotNull())
    rows = rows.withColumn("crossing", F.when(F.col("_ahead.pos") <= F.col("_terminal.pos"), F.col("_ahead")))
    rows = rows.withColumn("_open", F.when(F.col("crossing").isNotNull() & F.col("crossing.top").isNull(), F.col("crossing.pos")))
    rows = rows.join(open_ended, (F.col(by) == F.col("_by")) & (F.col("_open") == F.col("_from")), "left")
    many = F.col("_terminal.pos") - F.col("_open") + 1  # rows from the crossing to the terminal, the last of the descending list
    tail_top = F.array_max(F.slice("_after", -many, many))
    top = F.when(F.col("_open").isNotNull(), tail_top).otherwise(F.col("crossing.top"))
    without = F.col("_entry_top") if c.max_forward else first_best(lambda n: F.col(f"_terminal.{n}"))
    rows = rows.withColumn("_end", F.when(F.col("crossing").isNotNull(), top).otherwise(without))
    end = F.struct((-F.col("_end.back")).alias("pos"), F.col("_end.ts").alias("ts"), F.col("_end.price").alias("price"), F.col("_end.b_price").alias("b_price"))
    low_here = F.col("crossing.low")
    onset = F.when(F.col("crossing").isNotNull(), F.struct(low_here["pos"].alias("pos"), low_here["ts"].alias("ts"), low_here["price"].alias("price"), low_here["b_price"].alias("b_price"))).otherwise(F.col("entry"))
    rows = rows.withColumns({"onset": F.when(F.col("matured"), onset), "end": F.when(F.col("matured"), end)})
    return rows.select(
        F.col("ts").alias("decision_at"),
        by,
        "entry",
        "onset",
        F.when(F.col("matured"), F.col("crossing.at")).alias("crossing"),
        "end",
        F.when(F.col("matured"), F.col("_terminal.ts")).alias("horizon_end"),
        (F.try_divide(F.col("end.price"), F.col("onset.price")) - 1.0).alias("theme_return"),
        (F.try_divide(F.col("end.b_price"), F.col("onset.b_price")) - 1.0).alias("spy_return"),
        (F.try_divide(F.col("end.price"), F.col("entry.price")) - 1.0).alias("entry_to_peak_return"),
        "matured",
    )


def label_episodes(series: DataFrame, facts: DataFrame | None = None, config: EpisodeConfig | None = None, by: str = "theme") -> DataFrame:
    """Labels each decision. facts: (theme, decision_at) with any of breadth_up, breadth_beat_spy, active_names, theme_rank_percentile, top_decile.

    label_available_at is the peak, as reports have it; horizon_end is when the label is really known, and is what purging should use. Without a crossing the label is `none`; before
    the horizon has passed it is null.
    """
    rows = measured(series, config, by)
    names = ["breadth_up", "breadth_beat_spy", "active_names", "theme_rank_percentile", "top_decile"]
    if facts is not None:
        rows = rows.join(facts.select(by, "decision_at", *(n for n in names if n in facts.columns)), [by, "decision_at"], "left")
    rows = classify_moves(rows, config)
    crossed, matured = F.col("crossing").isNotNull(), F.col("matured")
    gates = ["breadth_ok", "breadth_up_ok", "breadth_beat_spy_ok", "min_names_ok", "top_decile_ok"]
    major, explosive = matured & crossed & F.col("major_surge"), matured & crossed & F.col("explosive")
    have = [n for n in names if n in rows.columns]
    return rows.select(
        "decision_at",
        by,
        F.col("entry.ts").alias("entry_at"),
        F.col("onset.ts").alias("onset"),
        F.col("crossing.ts").alias("first_80_crossing"),
        F.col("end.ts").alias("end"),
        F.col("end.ts").alias("peak"),
        F.col("end.ts").alias("label_available_at"),
        "horizon_end",
        "entry_to_peak_return",
        "theme_return",
        "spy_return",
        "excess_return",
        *have,
        *((matured & F.col(g)).alias(g) for g in gates),
        F.when(matured, F.when(crossed, F.col("label")).otherwise("none")).alias("label"),
        major.alias("major_surge"),
        explosive.alias("explosive"),
        (major | explosive).alias("qualifies"),
        "matured",
    )


def detect_episodes(labels: DataFrame, merge_gap_weeks: int = 13, by: str = "theme") -> DataFrame:
    """Of qualifying decisions, those that start an episode: in order, one at least merge_gap_weeks after the last start and after the last end. episode_id counts from 1.

    Whether a decision starts one hangs on the start before it, but where the next start after it would be doesn't: the first decision that is clear of it, found by an as-of look-up. These pointers are followed from each theme's first decision by doubling: after round k all starts
    up to the 2**k-th are known, and pointers skip 2**k starts. So rounds grow with the logarithm of a theme's episodes, each is a join by theme and time, and no task holds a theme; tables between rounds are written. Decisions without a theme don't count.
    """
    marks = labels.where(F.col("qualifies") & F.col(by).isNotNull()).groupBy(F.col(by).alias("_by"), F.col("decision_at").alias("_at")).agg(F.min("end").alias("_end"))
    marks = written(marks, "episode-marks")
    clear = F.greatest(F.col("_at") + F.make_dt_interval(F.lit(7 * merge_gap_weeks)), F.col("_end") + F.expr("interval '0.000001' second"))
    asks = marks.where("_end is not null").select("_by", "_at", clear.alias("_clear"))
    skip = first_at_or_after(asks, marks, "_by", "_clear", "_at", F.col("_at"), "_next").where("_next is not null").select("_by", "_at", "_next")
    skip = written(skip, "episode-next")
    starts = written(marks.groupBy("_by").agg(F.min("_at").alias("_at")).select("_by", "_at", F.lit(1).alias("episode_id")), "episode-starts")
    far = 1
    while True:
        more = written(starts.join(skip, ["_by", "_at"]).select("_by", F.col("_next").alias("_at"), (F.col("episode_id") + far).alias("episode_id")), "episode-starts")
        if more.isEmpty():
            break
        starts = starts.union(more)
        twice = skip.select("_by", F.col("_at").alias("_next"), F.col("_next").alias("_further"))
        skip = written(skip.join(twice, ["_by", "_next"]).select("_by", "_at", F.col("_further").alias("_next")), "episode-next")
        far *= 2
    starts = starts.select(F.col("_by").alias(by), F.col("_at").alias("decision_at"), "episode_id")
    return labels.join(starts, [by, "decision_at"]).where("qualifies").withColumnRenamed("decision_at", "start")

"""As-of look-ups over skewed series: by blocks of time, so that no task holds a whole group.

Questions and facts of a group become one stream, cut into blocks of time. What a block's questions need from before it is one row: the last (or largest) fact of all earlier blocks. These rows come from a small table, one row for each
group and block of facts, aggregated before its shuffle and carried forward up to the next block that has facts. They join the stream as its blocks' first rows, and a window over group and block answers the questions; those after a group's last block of facts
take its last row. There is no range join, a group of any size spreads over as many tasks as it has blocks, and questions are worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block. A block's rows of one group meet in one task, so a group of millions of rows in a quarter wants shorter ones.
BLOCK_WEEKS = 13
DAY = 86400


def block_of(at: Column, weeks: float = BLOCK_WEEKS) -> Column:
    """The number of the block of time in which a date or time lies."""
    return F.floor(F.unix_seconds(at.cast("timestamp")) / int(7 * weeks * DAY))


def _answered(questions: DataFrame, facts: DataFrame, largest: bool, weeks: float, ahead: bool = False) -> DataFrame:
    """questions (_by, _ts, _ask) with _found: of facts (_by, _ts, _fact) of the same _by with _ts at or before theirs, the latest (of equal times the larger) or, if largest, the largest _fact. ahead: the same in reversed time, so the earliest at or after
    theirs, of equal times the smaller."""
    kind = facts.schema["_fact"].dataType
    number = lambda c: -block_of(c, weeks) if ahead else block_of(c, weeks)
    facts = facts.where("_ts is not null and _fact is not null").select("_by", "_ts", "_fact", number(F.col("_ts")).alias("_block"))
    asked = questions.select("_by", "_ts", "_ask", number(F.col("_ts")).alias("_block"))
    best = F.max("_fact") if largest else (F.min if ahead else F.max)(F.struct("_ts", "_fact"))["_fact"]
    blocks = facts.groupBy("_by", "_block").agg(best.alias("_own"))
    order = Window.partitionBy("_by").orderBy("_block")
    blocks = blocks.select("_by", "_block", (F.max("_own").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) if largest else F.col("_own")).alias("_fact"), F.lead("_block").over(order).alias("_next"))
    carried = blocks.where("_next is not null").select("_by", F.explode(F.sequence(F.col("_block") + 1, "_next")).alias("_block"), "_fact")
    final = blocks.where("_next is null").select(F.col("_by").alias("_of"), F.col("_block").alias("_last"), F.col("_fact").alias("_final"))
    none = F.lit(None).cast(questions.schema["_ask"].dataType)
    row = lambda df, place, **have: df.select("_by", "_block", F.lit(place).alias("_place"), *(have.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("_ts", questions.schema["_ts"].dataType), ("_fact", kind))), have.get("_ask", none).alias("_ask"))
    stream = row(carried, 0, _fact=F.col("_fact")).unionByName(row(facts, 1, _ts=F.col("_ts").cast(questions.schema["_ts"].dataType), _fact=F.col("_fact"))).unionByName(row(asked, 2, _ts=F.col("_ts"), _ask=F.col("_ask")))
    order = Window.partitionBy("_by", "_block").orderBy(F.col("_place") != 0, *((F.col("_ts").desc(), "_place", F.col("_fact").desc()) if ahead else ("_ts", "_place", "_fact"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (F.max("_fact") if largest else F.last("_fact", ignorenulls=True)).over(order)
    found = stream.withColumn("_found", over).where("_place = 2").select("_by", "_block", "_ask", "_found")
    found = found.join(final, F.col("_by").eqNullSafe(F.col("_of")), "left")
    return found.select("_ask", F.when(F.col("_block") > F.col("_last"), F.col("_final")).when(F.col("_block").isNotNull(), F.col("_found")).alias("_found"))


def last_at_or_before(asks: DataFrame, facts: DataFrame, by: str, at: str, when: str, value: Column, out: str, weeks: float = BLOCK_WEEKS) -> DataFrame:
    """asks with a column `out`: value of the last row of facts at or before asks.<at>, in the same group; of several at that time the largest value. Null where there's none, and for asks without a time; facts without time or value don't count. Groups may be null."""
    questions = asks.select(F.col(by).alias("_by"), F.col(at).alias("_ts"), F.struct(*(F.col(c) for c in asks.columns)).alias("_ask"))
    found = _answered(questions, facts.select(F.col(by).alias("_by"), F.col(when).alias("_ts"), value.alias("_fact")), False, weeks)
    return found.select("_ask.*", F.col("_found").alias(out))


def largest_at_or_before(asks: DataFrame, facts: DataFrame, by: str, at: str, when: str, value: Column, out: str, weeks: float = BLOCK_WEEKS) -> DataFrame:
    """As last_at_or_before, but the largest value (a struct compares field by field) of all rows of facts at or before asks.<at>."""
    questions = asks.select(F.col(by).alias("_by"), F.col(at).alias("_ts"), F.struct(*(F.col(c) for c in asks.columns)).alias("_ask"))
    found = _answered(questions, facts.select(F.col(by).alias("_by"), F.col(when).alias("_ts"), value.alias("_fact")), True, weeks)
    return found.select("_ask.*", F.col("_found").alias(out))


def first_at_or_after(asks: DataFrame, facts: DataFrame, by: str, at: str, when: str, value: Column, out: str, weeks: float = BLOCK_WEEKS) -> DataFrame:
    """As last_at_or_before, in the other direction: value of the first row of facts at or after asks.<at>; of several at that time the smallest value."""
    questions = asks.select(F.col(by).alias("_by"), F.col(at).alias("_ts"), F.struct(*(F.col(c) for c in asks.columns)).alias("_ask"))
    found = _answered(questions, facts.select(F.col(by).alias("_by"), F.col(when).alias("_ts"), value.alias("_fact")), False, weeks, ahead=True)
    return found.select("_ask.*", F.col("_found").alias(out))

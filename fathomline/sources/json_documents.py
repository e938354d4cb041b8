"""Large JSON documents (one list, or one object with a list) read by many tasks.

A document is cut at every `}`, which Spark's text reader does from any byte offset. A piece alone doesn't say whether it begins inside a string, nor how deep it lies, but it says what it does to both: so quotes and brackets are summed
within blocks of at most BLOCK pieces of a split, and over the blocks in a table of one row each; so what a task sorts doesn't grow with the splits. Then every piece knows its depth, pieces between two ends of records are put together, and each record becomes a line of JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces of a split that are summed in one group: 2 to this power.
BLOCK = 14
BRACKETS = r"[^\[\]{}]*"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins, and which of its stretches of pieces), place, value; and what a piece does: flips (1 if it has an odd number of quotes), d0 and d1 (change of depth, its own `}` included, if it begins outside or inside a string)."""
    place = F.monotonically_increasing_id()
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("bytes"), place.alias("place"), "value")
    rows = rows.withColumn("block", F.struct("split", F.shiftright("place", BLOCK).alias("stretch"))).drop("split")
    plain = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    rows = rows.withColumn("_parts", plain).withColumn("flips", ((F.size("_parts") - 1) % 2).cast("bigint"))

    def change(inside: int) -> Column:
        out = F.concat_ws("", F.filter("_parts", lambda _, i: i % 2 == inside))
        opened, closed = F.length(F.regexp_replace(out, r"[^\[{]", "")), F.length(F.regexp_replace(out, r"[^\]]", ""))
        return (opened - closed - F.when(F.col("flips") == inside, 1).otherwise(0)).cast("bigint")

    return rows.withColumns({"d0": change(0), "d1": change(1)}).drop("_parts")


def _before(spec) -> Window:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds depth (after the piece's end) and outside (whether that end is outside strings)."""
    by, splits = Window.partitionBy("file", "block").orderBy("place"), Window.partitionBy("file").orderBy("block")
    flipped = F.coalesce(F.sum("flips").over(_before(by)), F.lit(0)) % 2
    own = pieces.withColumn("_q", flipped)
    here = own.select("*", *(F.sum(F.when(F.col("_q") == odd, F.col(one)).otherwise(F.col(other))).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for name, odd, one, other in (("_s0", 0, "d0", "d1"), ("_s1", 0, "d1", "d0"))))
    ends = here.groupBy("file", "block").agg(F.sum("flips").alias("_f"), F.max_by("_s0", "place").alias("_t0"), F.max_by("_s1", "place").alias("_t1"))
    ends = ends.withColumn("_p", F.coalesce(F.sum("_f").over(_before(splits)), F.lit(0)) % 2).withColumn("_t", F.when(F.col("_p") == 0, F.col("_t0")).otherwise(F.col("_t1")))
    ends = ends.select("file", "block", "_p", F.coalesce(F.sum("_t").over(_before(splits)), F.lit(0)).alias("_base"))
    both = here.join(ends, ["file", "block"])
    return both.select("file", "block", "place", "value", (F.col("_base") + F.when(F.col("_p") == 0, F.col("_s0")).otherwise(F.col("_s1"))).alias("depth"), ((F.col("_p") + F.col("_q") + F.col("flips")) % 2 == 0).alias("outside"))


def _records(placed: DataFrame, level: DataFrame) -> DataFrame:
    """file, record (its number from 0), done (whether it ends) and text, from what lies between its list's last record and its own end. level: file, the depth of its list and whether the file ends in `}`."""
    by, splits = Window.partitionBy("file", "block").orderBy("place"), Window.partitionBy("file").orderBy("block")
    rows = placed.join(F.broadcast(level), "file").withColumn("_end", (F.col("outside") & (F.col("depth") == F.col("level"))).cast("bigint"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("_end").over(_before(by)), F.lit(0)))
    base = rows.groupBy("file", "block").agg(F.sum("_end").alias("_n")).select("file", "block", F.coalesce(F.sum("_n").over(_before(splits)), F.lit(0)).alias("_first"))
    rows = rows.join(base, ["file", "block"]).withColumn("record", F.col("_first") + F.col("_own"))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    return rows.groupBy("file", "level", "closed", "record").agg(F.max("_end").alias("done"), parts.alias("_parts")).select("file", "level", "closed", "record", (F.col("done") == 1).alias("done"), F.array_join(F.transform("_parts", lambda p: p["value"]), "}").alias("text"))


def as_lines(spark: SparkSession, path: str, fields: list[str], target: str) -> bool:
    """Writes the records of a document, or of a folder of them, to target, a line each; whether that was possible.

    It is for a list that holds nothing but objects, at the top or in one of `fields` of an object whose other fields, before and after it, have no brackets. Of anything else nothing is said here, and a reader of whole documents must tell.
    Strings may hold brackets, quotes and escapes. A record must fit a row.
    """
    pieces = _pieces(spark, path)
    read = F.sum(F.octet_length("value") + 1)  # one byte more than there are, unless the last piece ends in `}` too; a byte order mark of three bytes isn't read
    heads = pieces.groupBy("file").agg(F.min_by("value", F.struct("block", "place")).alias("head"), (F.max("bytes") - read).isin(0, 3).alias("closed"))
    first = F.substring(F.regexp_replace("head", r"^[\x{FEFF}\s]+", ""), 1, 1)
    level = heads.select("file", "closed", F.when((first == "[") & ~F.col("closed"), 1).when(first == "{", 2).otherwise(0).alias("level"))
    rows = _records(_placed(pieces), level)
    names = "|".join(fields)
    opening = F.when(F.col("level") == 1, F.lit(r"(?s)^[\x{FEFF}\s]*\[\s*(?=\{)")).otherwise(F.lit(rf'(?s)^[\x{{FEFF}}\s]*\{{{BRACKETS}"(?:{names})"\s*:\s*\[\s*(?=\{{)'))
    lead = F.when(F.col("record") == 0, opening).otherwise(F.lit(r"(?s)^\s*,\s*(?=\{)"))
    tail = F.when(F.col("level") == 1, F.lit(r"(?s)^\s*\]\s*$")).when(F.col("closed"), F.lit(rf"(?s)^\s*\]{BRACKETS}$")).otherwise(F.lit(rf"(?s)^\s*\]{BRACKETS}\}}\s*$"))
    fits = F.when(F.col("done"), F.regexp_like("text", lead)).otherwise(F.regexp_like("text", tail))
    line = F.regexp_replace(F.concat(F.regexp_replace(F.col("text"), lead, F.lit("")), F.lit("}")), "[\r\n]+", " ")
    rows.select(F.when(F.col("done"), line).alias("value"), (fits & (F.col("level") > 0)).alias("fits"), "done", "file").write.parquet(f"{target}.parts")
    parts = spark.read.parquet(f"{target}.parts")
    each = parts.groupBy("file").agg(F.bool_and("fits").alias("fits"), F.count_if("done").alias("n"), F.count_if(~F.col("done")).alias("rest"))  # every file ends in something that is no record
    found = each.agg(F.bool_and(F.col("fits") & (F.col("n") > 0) & (F.col("rest") == 1)).alias("fits")).first()
    if not found["fits"]:
        return False
    parts.where("done").select("value").write.text(target)
    return True

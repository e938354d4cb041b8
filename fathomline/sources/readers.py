"""Readers of loosely written price files: JSON, JSON lines, delimited text; long or wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.functions.parsing import canonical, safe_date, safe_number
from fathomline.sources import files
from fathomline.sources.json_documents import as_lines
from fathomline.sources.shared import scratch

#: Names under which columns come.
ALIASES = {
    "date": ["date", "observed_at", "timestamp", "time", "as_of"],
    "theme": ["theme", "theme_id"],
    "security": ["security", "symbol", "ticker"],
    "value": ["value", "close", "price", "adj_close"],
}
ENTITY = ["entity", "symbol", "ticker", "security", "theme", "name", "permanent_id"]
LIST_FIELDS = ["rows", "data", "records", "items"]
#: From which size on, in bytes, a JSON document is cut into records first; rows are the same below and above.
SPLIT_ABOVE = 64 << 20
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def sniffed_delimiter(sample: str) -> str:
    """The separator that the first line has most of; a comma, if none."""
    head = sample.lstrip("﻿").splitlines()[0] if sample.strip() else ""
    return max(",;\t|", key=lambda c: (head.count(c), c == ","))


def _first_bad_line(spark: SparkSession, path: str) -> str | None:
    """Where a file of JSON lines has its first line that isn't JSON: file, number and content. Only looked for when there is one, so the count of the lines before it may take a pass of its own."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    line = F.trim("value")
    bad = lines.where((line != "") & F.try_parse_json("value").isNull() & ~line.rlike(r"^-?(?:NaN|Infinity)$")).orderBy("file", "place").first()
    if bad is None:
        return None
    before = lines.where((F.col("file") == bad["file"]) & (F.col("place") <= bad["place"])).count()
    return f"{bad['file']}, line {before}: not JSON: {bad['value'][:100]}"


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Objects, a line each. The pass that finds the schema also finds lines that aren't objects: such a line is skipped if it is JSON (a number, a string), else an error names it."""
    corrupt = "_corrupt_record"
    rows = spark.read.option("columnNameOfCorruptRecord", corrupt).json(path)
    if corrupt not in rows.columns:
        return rows
    where = _first_bad_line(spark, path)
    if where:
        raise ValueError(where)
    objects = spark.read.text(path).where(F.trim("value").startswith("{"))
    kind = StructType([f for f in rows.schema if f.name != corrupt])
    return objects.select(F.from_json("value", kind).alias("_row")).select("_row.*")


def has_line_ends_in_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of delimited text goes over a line end: then, and only then, some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_rows(spark: SparkSession, path: str, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """.json: a list, an object with a list under one of LIST_FIELDS, or one object; .jsonl: objects, a line each; else delimited text with a header. Rows that are all blank go; what isn't JSON raises ValueError.

    A JSON document of more than split_above bytes is cut into records by many tasks (json_documents), where its list holds nothing but objects and no other field has brackets; any other is read by one task, with the same rows. Text after the end of a document is not looked at.
    Quoted cells of delimited text may hold separators, doubled quotes and line ends. Files without line ends in cells are split over tasks; only those that have them, which one pass over the text tells, are read by a task each.
    """
    if path.endswith(".jsonl"):
        return _json_lines(spark, path)
    if path.endswith(".json"):
        lines = scratch(spark, "records") if files.size(spark, path) > split_above else None
        if lines and as_lines(spark, path, LIST_FIELDS, lines):
            try:
                return _json_lines(spark, lines)
            except ValueError as error:
                raise ValueError(f"{path}: not JSON: {str(error).partition('not JSON: ')[2]}") from None
        rows = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        if "_corrupt_record" in rows.columns:
            raise ValueError(f"{path}: not JSON")
        for name in LIST_FIELDS:
            if name in rows.columns and rows.schema[name].dataType.simpleString().startswith("array<struct"):
                return rows.select(F.inline(name))
        return rows
    first = spark.read.text(path).limit(1).collect()
    sep = sniffed_delimiter(first[0][0] if first else "")
    options = {"header": True, "sep": sep, "encoding": "UTF-8", "quote": '"', "escape": '"', "multiLine": has_line_ends_in_cells(spark, path)}
    rows = spark.read.options(**options).csv(path)
    rows = rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))
    return rows.where(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns)).isNotNull()) if rows.columns else rows


def _pick(rows: DataFrame, names: list[str]) -> Column | None:
    have = {canonical(c): c for c in reversed(rows.columns)}
    found = [F.nullif(F.trim(F.col(f"`{have[canonical(n)]}`").cast("string")), F.lit("")) for n in names if canonical(n) in have]
    return F.coalesce(*found) if found else None


def tidy_panel(rows: DataFrame) -> DataFrame | None:
    """date, theme, security, value from any aliases; rows in which one can't be read go. None if a column is missing altogether."""
    picked = {k: _pick(rows, names) for k, names in ALIASES.items()}
    if any(v is None for v in picked.values()):
        return None
    return rows.select(safe_date(picked["date"]).alias("date"), picked["theme"].alias("theme"), picked["security"].alias("security"), safe_number(picked["value"]).alias("value")).dropna()


def unpivoted(rows: DataFrame, date: str) -> DataFrame:
    """Each numeric column of a wide table as an entity: date, entity, value, without nulls."""
    names = [c for c, kind in rows.dtypes if c != date and kind in NUMERIC]
    wide = rows.select(date, *(F.col(f"`{c}`").cast("double").alias(c) for c in names))
    return wide.unpivot([date], names, "entity", "value").where("value is not null").withColumnRenamed(date, "date")


def normalised_records(rows: DataFrame) -> DataFrame:
    """entity, date, value of a long table, or of a wide one if there's no column for entities."""
    when, who, value = _pick(rows, ALIASES["date"]), _pick(rows, ENTITY), _pick(rows, ALIASES["value"])
    if who is not None:
        numeric = [F.col(f"`{c}`").cast("string") for c, kind in rows.dtypes if kind in NUMERIC]
        amount = value if value is not None else (numeric[0] if numeric else F.lit(None).cast("string"))
        return rows.select(who.alias("entity"), safe_date(when if when is not None else F.lit(None)).alias("date"), safe_number(amount).alias("value"))
    names = [c for c in rows.columns if canonical(c) not in {canonical(n) for n in ALIASES["date"]}]
    wide = rows.select(safe_date(when if when is not None else F.lit(None)).alias("date"), *(safe_number(F.col(f"`{c}`")).alias(c) for c in names))
    return unpivoted(wide, "date").select("entity", "date", "value")


def price_observations(rows: DataFrame, default_evidence: str | None = None) -> DataFrame:
    """permanent_id, symbol, observed_at, evidence_available_at, value, source, metric, currency, complete. An id falls back to `ticker:<symbol>`, evidence to the default and then to the
    observation itself, which makes the row incomplete. A row without id, date or value raises with its content."""
    pick = lambda *names: (lambda c: c if c is not None else F.lit(None).cast("string"))(_pick(rows, list(names)))
    symbol = pick("symbol", "ticker")
    known = safe_date(pick("evidence_available_at", "available_at", "evidence_at"))
    observed = safe_date(pick("observed_at", "date", "timestamp"))
    fallback = safe_date(F.lit(default_evidence)) if default_evidence else F.lit(None).cast("timestamp_ntz")
    out = rows.select(
        F.coalesce(pick("permanent_id", "instrument_id", "security_id", "id"), F.concat(F.lit("ticker:"), F.lower(symbol))).alias("permanent_id"),
        F.coalesce(symbol, F.lit("")).alias("symbol"),
        observed.alias("observed_at"),
        F.coalesce(known, fallback, observed).alias("evidence_available_at"),
        safe_number(pick("close", "adj_close", "price", "value")).alias("value"),
        F.coalesce(pick("source", "source_id"), F.lit("csv_fixture")).alias("source"),
        F.coalesce(pick("metric"), F.lit("close")).alias("metric"),
        pick("currency").alias("currency"),
        F.coalesce(known, fallback).isNotNull().alias("complete"),
    )
    bad = out.where("permanent_id is null or observed_at is null or value is null").head(1)
    if bad:
        raise ValueError(f"invalid price row: {bad[0].asDict()}")
    return out


def prices_between(observations: DataFrame, name: str, start: str, end: str, as_of: str | None = None) -> DataFrame:
    """Observations of an id or symbol (any case) from start to end, both included, whose evidence was known by as_of; in order."""
    rows = observations.where((F.lower("permanent_id") == name.lower()) | (F.lower("symbol") == name.lower()))
    rows = rows.where(F.to_date("observed_at").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if as_of:
        rows = rows.where(F.to_date("evidence_available_at") <= F.to_date(F.lit(as_of)))
    return rows.orderBy("observed_at")

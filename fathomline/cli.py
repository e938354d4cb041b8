"""Command line: python -m fathomline.cli COMMAND. Results go to standard output as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import membership, scorecard
from fathomline.plans import annual, pipeline
from fathomline.sources import catalog, readers, scorecards


#: Weeks of the demo, and for each of its series the weekly rate, the week from which it changes, and the rate from then on.
DEMO_WEEKS, DEMO_START = 150, "2022-01-07"
DEMO_RATES = [("__market__", "SPY", 0.002, 150, 0.002), ("태양광", "태양광", 0.001, 65, 0.018), ("반도체", "반도체", 0.004, 95, 0.014), ("양자컴퓨팅", "양자컴퓨팅", 0.001, 120, 0.022)]


def annual_demo(spark: SparkSession) -> DataFrame:
    """A weekly panel of three themes that take off one after the other, and the benchmark."""
    series = spark.createDataFrame(DEMO_RATES, "theme string, security string, early double, turn int, late double")
    n, turn = F.col("id") + 1, F.col("turn")
    value = 100.0 * F.pow(1.0 + F.col("early"), F.least(n, turn)) * F.pow(1.0 + F.col("late"), F.greatest(n - turn, F.lit(0)))
    return spark.range(DEMO_WEEKS).join(F.broadcast(series), F.lit(True)).select(F.date_add(F.lit(DEMO_START).cast("date"), (F.col("id") * 7).cast("int")).cast("timestamp_ntz").alias("date"), "theme", "security", value.alias("value"))


#: The order of each kind of result at the sink. Lanes and tables are unordered until then.
ORDERS = {"signals": ["decision_date", "theme"], "annual": ["year", "rank", "theme"], "early": ["decision_date", "theme"], "score": ["-score", "entity"], "catalog": ["theme"]}


def ordered(rows: DataFrame, kind: str) -> DataFrame:
    return rows.orderBy(*(F.desc(n[1:]) if n[0] == "-" else F.asc(n) for n in ORDERS[kind] if n.lstrip("-") in rows.columns))


def emit(rows: DataFrame, limit: int | None, table: bool = False) -> None:
    """Rows as JSON lines or, with table, in columns, of which a row each is held."""
    rows = rows.limit(limit) if limit else rows
    if not table:
        for line in rows.toJSON().toLocalIterator():
            print(line)
        return
    print(" | ".join(rows.columns))
    for row in rows.toLocalIterator():
        print(" | ".join("-" if v is None else str(v) for v in row))


def panel_of(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return annual_demo(spark)
    rows = readers.tidy_panel(readers.read_rows(spark, path))
    if rows is None:
        raise SystemExit("the file lacks a date, theme, security or value column")
    return rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fathomline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("signals", "annual", "early", "score", "validate", "catalog", "scorecard"):
        own = commands.add_parser(name)
        own.add_argument("path", nargs="?")
        own.add_argument("--as-of")
        own.add_argument("--limit", type=int)
        own.add_argument("--table", action="store_true")
        own.add_argument("--lane", choices=["current_leader", "emerging_radar", "hold_candidate_12m"], default="current_leader")
    commands.add_parser("doctor")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "doctor":
        print(f'{{"spark": "{spark.version}", "python": "{sys.version.split()[0]}"}}')
        return 0
    if args.command == "signals":
        rows = pipeline.latest_cross_section(pipeline.run_signal_pipeline(panel_of(spark, args.path), args.as_of).lanes[args.lane])
    elif args.command == "annual":
        rows = annual.annual_theme_leaders(panel_of(spark, args.path), as_of=args.as_of)
    elif args.command == "early":
        rows = annual.latest_by_theme(annual.early_rise_signals(panel_of(spark, args.path), as_of=args.as_of))
    elif args.command == "score":
        rows = scorecard.scorecard(readers.normalised_records(readers.read_rows(spark, args.path)))
    elif args.command == "scorecard":
        rows = scorecards.load_scorecard(spark, args.path)[0]
    elif args.command == "validate":
        records = readers.normalised_records(readers.read_rows(spark, args.path))
        rows = scorecard.validation_counts(records.select("entity", F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value")))
    elif args.as_of:
        own = catalog.load_catalog(spark, args.path)
        rows = membership.theme_counts(own.themes, membership.memberships_as_of(own.memberships, args.as_of))
    else:
        rows = catalog.catalog_items(spark, args.path)[0]
    kind = "score" if args.command == "scorecard" else args.command
    emit(ordered(rows, kind) if kind in ORDERS else rows, args.limit, args.table)
    return 0


if __name__ == "__main__":
    sys.exit(main())

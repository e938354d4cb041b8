"""Queries of readers, catalog, provenance, guards, audits' examples, look-ups and sinks, each with its DuckDB twin.

What readers read is written first, loosely, from the star-schema tables, into a new folder of the shared directory.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline import cli
from fathomline.config import EpisodeConfig, PanelConfig, SplitConfig
from fathomline.functions import parsing
from fathomline.more_queries import EASY_ANNUAL, FEATURES, MEMBERS, SCORES, SERIES, TODAY, annual_sql, entity_records, feature_table, forward_sql, gains_sql, index_series, lane_sql, membership_table, move_table, score_tables
from fathomline.operators import audits, early_hits, labels, membership, panel, rank_metrics, scorecard, splits
from fathomline.plans import annual, lanes, pipeline
from fathomline.queries import AS_OF, EASY_HOLD, EASY_LEADER, EASY_RADAR, _panel, query, r6, with_panel
from fathomline.sources import catalog, challenges, provenance, providers, readers, scorecards
from fathomline.sources.shared import scratch, written
from fathomline.sources.testdata import lineitem_panel, table


# --- readers ---

LOOSE = """select date_format(o_orderdate, element_at(array('yyyy-MM-dd', 'yyyy/MM/dd', 'yyyyMMdd', 'MM/dd/yyyy'), cast(o_orderkey % 4 + 1 as int))) as `Observed At`, concat(' ', o_orderstatus, ' ') as `Theme ID`, concat('c', o_custkey) as Ticker,
    case when o_orderkey % 11 = 0 then 'n/a' when o_orderkey % 3 = 0 then concat('$', format_number(o_totalprice, 2)) else cast(o_totalprice as string) end as `Adj Close` from orders"""
READ = "select cast(cast(o_orderdate as date) as timestamp) as date, o_orderstatus as theme, 'c' || o_custkey as security, round(cast(o_totalprice as double), 2) + 0.0 as value from orders where o_orderkey % 11 <> 0"


def loose_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({"o_orderdate": F.to_date("o_orderdate"), "o_totalprice": F.round(F.col("o_totalprice").cast("double"), 2)})
    return spark.sql(LOOSE.replace("from orders", "from {orders}"), orders=orders)


@query("read_delimited", READ)
def read_delimited(spark, sf_dir):
    """Delimited text with a separator of its own, names to be matched, dates in four formats and numbers with signs."""
    path = scratch(spark)
    loose_orders(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return readers.tidy_panel(readers.read_rows(spark, path))


@query("read_json_lines", "select o_orderpriority as entity, cast(cast(o_orderdate as date) as timestamp) as date, round(cast(o_totalprice as double), 6) + 0.0 as value from orders")
def read_json_lines(spark, sf_dir):
    path = scratch(spark) + ".jsonl"
    table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("Name"), F.to_date("o_orderdate").cast("string").alias("as_of"), F.col("o_totalprice").cast("double").alias("Price")).write.json(path)
    return readers.normalised_records(readers.read_rows(spark, path))


@query("read_json_list", "select n_name as entity, cast(date '2024-01-05' + cast(n_nationkey as integer) as timestamp) as date, cast(n_regionkey + 0.5 as double) as value from nation")
def read_json_list(spark, sf_dir):
    """One object with a list of records."""
    path = scratch(spark) + ".json"
    each = F.struct(F.col("n_name").alias("symbol"), F.date_add(F.lit("2024-01-05").cast("date"), F.col("n_nationkey").cast("int")).cast("string").alias("timestamp"), (F.col("n_regionkey") + 0.5).cast("double").alias("close"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(each).alias("records"))).alias("value")).coalesce(1).write.text(path)
    return readers.normalised_records(readers.read_rows(spark, path))


@query("read_json_document", "select 'c' || o_custkey as entity, cast(cast(o_orderdate as date) as timestamp) as date, round(cast(o_totalprice as double), 6) + 0.0 as value from orders")
def read_json_document(spark, sf_dir):
    """A folder of documents that hold all orders, an object with a list for each task that wrote, cut into records from any byte offset; strings hold what looks like the end of a list."""
    path, orders = scratch(spark) + ".json", table(spark, sf_dir, "orders")
    record = F.to_json(F.struct(F.concat(F.lit("c"), "o_custkey").alias("symbol"), F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").cast("double").alias("close"), F.concat(F.lit('}],"'), "o_orderpriority").alias("note")))
    part, place = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    own = orders.select(record.alias("value"), part, place)
    ends = own.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    lines = own.join(F.broadcast(ends), "part").select(F.concat(F.when(F.col("place") == F.col("first"), '{"source": "orders", "rows": [').otherwise(""), "value", F.when(F.col("place") == F.col("last"), "]}").otherwise(",")).alias("value"))
    lines.write.options(compression="none", maxRecordsPerFile=0).text(path)  # a part's rows are one task's, in order: nothing is shuffled or sorted
    return readers.normalised_records(readers.read_rows(spark, path, split_above=0))


@query(
    "read_quoted_cells",
    "select n_name || chr(10) || 'of \"' || r_name || '\", both' as symbol, cast(date '2024-01-05' + cast(n_nationkey as integer) as timestamp) as date, cast(n_nationkey as double) as value from nation join region on r_regionkey = n_regionkey",
)
def read_quoted_cells(spark, sf_dir):
    """Cells with separators, doubled quotes and line ends."""
    path, quote = scratch(spark), F.lit('"')
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    cell = F.concat(quote, "n_name", F.lit('\nof ""'), "r_name", F.lit('"", both'), quote)
    lines = names.select(F.concat_ws(",", F.date_add(F.lit("2024-01-05").cast("date"), F.col("n_nationkey").cast("int")).cast("string"), cell, F.col("n_nationkey").cast("string")).alias("value"))
    head = spark.createDataFrame([("date,symbol,close",)], "value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions(F.col("value").startswith("date").cast("int").desc()).write.text(path)
    rows = readers.read_rows(spark, path)
    return rows.select("symbol", parsing.safe_date(F.col("date")).alias("date"), parsing.safe_number(F.col("close")).alias("value"))


@query("read_bad_json_line", "select 'line ' || cast((select count(*) from nation where n_nationkey <= 4) as varchar) as place, count(*) as good from nation where n_regionkey > 0")
def read_bad_json_line(spark, sf_dir):
    """A line that isn't JSON is an error that names it; lines of JSON that aren't objects are skipped."""
    path, nations = scratch(spark) + ".jsonl", table(spark, sf_dir, "nation")
    record = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value")))
    line = F.when(F.col("n_regionkey") > 0, record).otherwise(F.lit("17"))
    nations.select(line.alias("value")).coalesce(1).write.text(path)
    good = readers.read_rows(spark, path)
    torn = F.when(F.col("n_nationkey") == 4, F.lit('{"name": "torn')).otherwise(record)
    path = scratch(spark) + ".jsonl"
    nations.select(torn.alias("value"), "n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    try:
        readers.read_rows(spark, path)
        place = "no error"
    except ValueError as error:
        place = str(error).partition(", ")[2].partition(":")[0]
    return good.agg(F.lit(place).alias("place"), F.count("*").alias("good"))


@query("read_wide", "select date, entity, value from (select cast(d as timestamp) as date, unnest(['low', 'high']) as entity, unnest([lo, hi]) as value from (select cast(o_orderdate as date) as d, round(min(cast(o_totalprice as double)), 6) + 0.0 as lo, round(max(cast(o_totalprice as double)), 6) + 0.0 as hi from orders group by 1))")
def read_wide(spark, sf_dir):
    path = scratch(spark)
    price = F.col("o_totalprice").cast("double")
    table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min(price).alias("low"), F.max(price).alias("high")).write.option("header", True).csv(path)
    return readers.normalised_records(readers.read_rows(spark, path))


@query(
    "price_provider",
    "select case when o_orderkey % 2 = 0 then 'id-' || o_orderstatus else 'ticker:' || lower(o_orderstatus) end as permanent_id, o_orderstatus as symbol, cast(cast(o_orderdate as date) as timestamp) as observed_at, "
    "cast(cast(o_orderdate as date) + case when o_orderkey % 3 = 0 then 0 else cast(o_orderkey % 20 as integer) end as timestamp) as evidence_available_at, round(cast(o_totalprice as double), 6) + 0.0 as value, o_orderkey % 3 <> 0 as complete from orders "
    "where o_orderstatus = 'F' and cast(o_orderdate as date) between date '1994-03-01' and date '1996-06-30' and cast(o_orderdate as date) + case when o_orderkey % 3 = 0 then 0 else cast(o_orderkey % 20 as integer) end <= date '1996-01-31'",
)
def price_provider(spark, sf_dir):
    """Ids that fall back to the ticker, evidence that falls back to the observation; then a range that was known by a day."""
    path, day = scratch(spark), F.to_date("o_orderdate")
    table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("id-"), "o_orderstatus")).alias("permanent_id"),
        F.col("o_orderstatus").alias("symbol"),
        day.alias("date"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_add(day, (F.col("o_orderkey") % 20).cast("int"))).alias("available_at"),
        F.col("o_totalprice").cast("double").alias("close"),
    ).write.option("header", True).csv(path)
    own = providers.FilePriceProvider(spark, path)
    return own.get_prices("f", "1994-03-01", "1996-06-30", as_of="1996-01-31").select("permanent_id", "symbol", "observed_at", "evidence_available_at", "value", "complete")


class NationPrices(providers.NetworkPriceProvider):
    """A connector whose far end is a folder of prices by symbol, to hold the gate and the contract against: each request opens its symbol's files in its own task. Spark writes the folder from the nations, once for a provider."""

    def __init__(self, spark: SparkSession, sf_dir: str, **options) -> None:
        super().__init__(spark, **options)
        self.path = scratch(spark, "nation-prices")
        if self.enabled:
            table(spark, sf_dir, "nation").select(F.upper("n_name").alias("symbol"), F.col("n_nationkey").cast("double").alias("key")).write.partitionBy("symbol").parquet(self.path)

    def connector(self) -> providers.Fetch:
        path = self.path

        def fetch(symbol: str, start: date, end_exclusive: date):
            import pyarrow.dataset as ds
            from pyarrow import fs

            files, root = fs.FileSystem.from_uri(path)
            where = f"{root}/symbol={symbol}"
            if files.get_file_info(where).type == fs.FileType.NotFound:
                return []
            keys = ds.dataset(where, filesystem=files, format="parquet").to_table(columns=["key"])["key"].to_pylist()
            return [(day, key) for key in keys for day in (start, date.fromordinal(end_exclusive.toordinal() - 1))]

        return fetch


@query("network_gate", "select 'off' as kind, cast(null as date) as observed_at, cast(null as double) as value union all select 'on', unnest([date '2024-01-02', date '2024-01-09']), cast(n_nationkey as double) from nation where n_nationkey = 7")
def network_gate(spark, sf_dir):
    """Off without consent, nothing for days before the retrieval, both ends of the range otherwise."""
    symbol = f"ticker:{table(spark, sf_dir, 'nation').where('n_nationkey = 7').first()['n_name'].lower()}"
    try:
        NationPrices(spark, sf_dir, enabled=False).get_prices(symbol, "2024-01-02", "2024-01-09")
        off = spark.createDataFrame([], "kind string, observed_at date, value double")
    except providers.ProviderDisabled:
        off = spark.createDataFrame([("off", None, None)], "kind string, observed_at date, value double")
    on = NationPrices(spark, sf_dir, enabled=True, today=date(2024, 6, 1))
    found = on.get_prices(symbol, "2024-01-02", "2024-01-09").unionByName(on.get_prices(symbol, "2024-01-02", "2024-01-09", as_of="2024-05-31"))
    return off.unionByName(found.select(F.lit("on").alias("kind"), "observed_at", "value"))


@query(
    "parse_cells",
    """select user_id, event_id, round(case when event_id % 7 = 0 then null when event_id % 5 = 0 then value / 100 else value end, 6) + 0.0 as number, case event_id % 4 when 0 then 0.9 when 1 then 0.65 when 2 then 0.35 end::double as confidence,
        case when event_id % 3 = 0 then cast(cast(ts as date) as timestamp) when event_id % 3 = 1 then date_trunc('second', ts) end as day from events""",
)
def parse_cells(spark, sf_dir):
    raw = F.col("value").cast("string")
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd/MM/yyyy")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon")
    day = F.when((F.col("event_id") % 3 == 0) & (F.dayofmonth("ts") <= 12), F.date_format("ts", "MM/dd/yyyy")).otherwise(day)  # a day that may be a month is one
    number = F.when(F.col("event_id") % 7 == 0, F.element_at(F.array(*map(F.lit, ["", " - ", "N/A", "nan", "None", "x1"])), (F.col("event_id") % 6 + 1).cast("int"))).when(F.col("event_id") % 5 == 0, F.concat(raw, F.lit(" %"))).otherwise(F.concat(F.lit(" $"), raw))
    word = F.element_at(F.array(*map(F.lit, ["High", " medium", "LOW", "unsure"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", parsing.safe_number(number).alias("number"), parsing.confidence(word).alias("confidence"), parsing.safe_date(day).alias("day"))


# --- catalog ---


def catalog_folder(spark, sf_dir) -> str:
    """regions as themes, nations as their members; Spark writes both files."""
    folder = scratch(spark, "catalog")
    regions, theme = table(spark, sf_dir, "region"), F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_")))
    entry = F.concat(
        F.when(F.row_number().over(Window.orderBy("r_regionkey")) == 1, "version: 1\nthemes:  # one for each region\n").otherwise(""),
        F.format_string("  - theme_id: %s\n    name: '%s'\n    category: \"region %s\"\n    is_negative_control: %s", theme, "r_name", "r_regionkey", F.when(F.col("r_regionkey") % 2 == 1, "true").otherwise("false")),
    )
    regions.select(entry.alias("value"), "r_regionkey").coalesce(1).sortWithinPartitions("r_regionkey").select("value").write.text(f"{folder}/themes.yaml")
    key, known = F.col("n_nationkey"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("n_nationkey") % 27).cast("int"))
    table(spark, sf_dir, "nation").join(regions, F.col("r_regionkey") == F.col("n_regionkey")).select(
        theme.alias("theme_id"),
        F.concat(F.lit("ticker:"), key).alias("permanent_id"),
        F.lower(F.substring("n_name", 1, 3)).alias("symbol"),
        F.lit("2020-01-01").alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"),
        known.cast("string").alias("evidence_available_at"),
        F.lit("core").alias("exposure_tier"),
        F.when(key % 2 == 1, "high").otherwise("0.5").alias("confidence"),
    ).write.option("header", True).csv(f"{folder}/memberships.csv")
    return folder


THEME_ID = "lower(replace(r_name, ' ', '_'))"


@query("catalog_members", f"select {THEME_ID} as theme_id, upper(substr(n_name, 1, 3)) as symbol, date '2020-01-01' + cast(n_nationkey % 27 as integer) as evidence_available_at, case when n_nationkey % 2 = 1 then 0.9 else 0.5 end::double as confidence, cast(null as date) as valid_to from nation join region on n_regionkey = r_regionkey")
def catalog_members(spark, sf_dir):
    return catalog.load_catalog(spark, catalog_folder(spark, sf_dir)).memberships.select("theme_id", "symbol", "evidence_available_at", "confidence", "valid_to")


@query("catalog_controls", f"select {THEME_ID} as theme_id, r_name as name, 'region ' || r_regionkey as category from region where r_regionkey % 2 = 1")
def catalog_controls(spark, sf_dir):
    return catalog.load_catalog(spark, catalog_folder(spark, sf_dir)).negative_controls().select("theme_id", "name", "category")


@query(
    "catalog_items",
    f"select 'catalog' as kind, r_name as theme, count(n_name) as n from region left join nation on n_regionkey = r_regionkey group by r_name union all select 'file', {THEME_ID}, count(*) from nation join region on n_regionkey = r_regionkey group by 2 "
    "union all select 'fallback', unnest(['AI Infrastructure', 'Cybersecurity', 'Grid Modernization']), 0",
)
def catalog_items(spark, sf_dir):
    """A whole catalog, a folder that has only rows, and nothing at all."""
    folder = catalog_folder(spark, sf_dir)
    whole = catalog.catalog_items(spark, folder)[0].select(F.lit("catalog").alias("kind"), "theme", F.col("memberships").alias("n"))
    spark.read.option("header", True).csv(f"{folder}/memberships.csv").write.option("header", True).csv(f"{folder}/rows/members.csv")
    file = catalog.catalog_items(spark, f"{folder}/rows")[0].groupBy(F.lit("file").alias("kind"), F.col("theme_id").alias("theme")).agg(F.count("*").alias("n"))
    none = catalog.catalog_items(spark, None, [folder])[0].select(F.lit("fallback").alias("kind"), "theme", F.lit(0).cast("bigint").alias("n"))
    return whole.unionByName(file).unionByName(none)


CASES = [(*c[:4], True, c[4], c[5]) for c in challenges.SURGES] + [(n, n, *challenges.CONTROL_DAYS, False, "negative_control", about) for n, about in challenges.CONTROLS]


@query(
    "challenge_cases",
    "with d as (select cast(o_orderdate as date) + interval 27 year as day, count(*) as n from orders group by 1) select name, theme, cast(s as date) as start, cast(e as date) as \"end\", pos as expected_positive, kind as case_type, about as description, not pos as is_negative_control, "
    "'research_challenge_manifest' as source, coalesce(sum(n), 0)::bigint as observations from (values "
    + ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else "'" + x + "'" for x in c) + ")" for c in CASES)
    + ") v(name, theme, s, e, pos, kind, about) left join d on d.day between cast(s as date) and cast(e as date) group by all",
)
def challenge_cases(spark, sf_dir):
    """The windows with the number of orders that lie in each, 27 years on. Orders are counted by day first; the windows are a fixed list of a dozen."""
    cases = challenges.challenge_cases(spark)
    challenges.validate_challenges(cases)
    days = table(spark, sf_dir, "orders").groupBy(F.add_months(F.to_date("o_orderdate"), 27 * 12).alias("day")).agg(F.count("*").alias("n"))
    inside = days.join(F.broadcast(cases.select("name", "start", "end")), F.col("day").between(F.col("start"), F.col("end"))).groupBy("name").agg(F.sum("n").alias("n"))
    rows = cases.join(inside, "name", "left").withColumn("observations", F.coalesce("n", F.lit(0)))
    return rows.select("name", "theme", "start", "end", "expected_positive", "case_type", "description", "is_negative_control", "source", "observations")


# --- provenance and sinks ---


@query("file_checksums", "select n_nationkey, sha256(n_name || '/' || n_regionkey) as sha256, length(n_name || '/' || n_regionkey) as bytes, true as verified, true as kept from nation")
def file_checksums(spark, sf_dir):
    """A file for each nation, written by tasks and hashed where Spark reads it, with a manifest that comes back from JSON and holds its payload."""
    path = scratch(spark, "files")
    payloads = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws("/", "n_name", "n_regionkey").alias("payload"))

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root)
        for rows in batches:
            for key, payload in zip(rows["n_nationkey"], rows["payload"]):
                with system.open_output_stream(f"{root}/{key}.bin") as out:
                    out.write(payload.encode())
            yield rows[["n_nationkey"]]

    def verified(batches):
        for rows in batches:
            for i, r in rows.iterrows():
                payload = r["payload"].encode()
                unmarked = provenance.SourceManifest("s", f"file:{r['n_nationkey']}", None, "2024-01-01", "2024-01-01")
                own = provenance.SourceManifest("s", f"file:{r['n_nationkey']}", r["sha256"], "2024-01-01", "2024-01-01", row_count=1)
                rows.loc[i, "verified"] = own.verify(payload) and not own.verify(payload + b"x") and not unmarked.verify(payload)
                rows.loc[i, "kept"] = provenance.SourceManifest.from_json(own.to_json()) == own
            yield rows.drop(columns="payload")

    payloads.mapInPandas(write, "n_nationkey int").count()
    sums = provenance.file_checksums(spark, path).select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("int").alias("n_nationkey"), "sha256", "bytes")
    both = payloads.join(sums, "n_nationkey").withColumns({"verified": F.lit(False), "kept": F.lit(False)})
    return both.select("n_nationkey", "payload", "sha256", "bytes", "verified", "kept").mapInPandas(verified, "n_nationkey int, sha256 string, bytes bigint, verified boolean, kept boolean")


@query("snapshot_cache", "select n_nationkey, n_name, n_regionkey, true as has_manifest, true as dropped from nation")
def snapshot_cache(spark, sf_dir):
    """Put with a manifest, overwritten without one: the rows are the new ones and the manifest is gone. A memory cache does the same."""
    cache, memory = provenance.SnapshotCache(spark, scratch(spark)), provenance.MemoryCache()
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    mark = provenance.SourceManifest("nation", "table:nation", None, "2024-01-01", "2024-01-01")
    cache.put("k", rows.limit(0), mark)
    memory.put("k", None, mark)
    had = cache.manifest("k") == mark and memory.manifest("k") == mark
    cache.put("k", rows)
    memory.put("k", rows)
    gone = cache.manifest("k") is None and memory.manifest("k") is None
    kept = cache.get("k")
    cache.put("other", rows.limit(1))
    cache.delete("other")
    gone = gone and "other" not in cache and "k" in memory and memory.get("k") is rows
    return kept.select("*", F.lit(had).alias("has_manifest"), F.lit(gone).alias("dropped"))


@query("snapshot_versions", "select n_nationkey, n_name, n_regionkey, true as kept, true as old_readable, 2 as versions from nation where n_regionkey > 0")
def snapshot_versions(spark, sf_dir):
    """A put that fails leaves rows and manifest as they were; a frame read from a key can be put under it; a reader of the older version keeps it."""
    cache = provenance.SnapshotCache(spark, scratch(spark))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    mark = provenance.SourceManifest("nation", "table:nation", None, "2024-01-01", "2024-01-01")
    cache.put("k", rows, mark)
    try:
        cache.put("k", rows.withColumn("n_name", F.when(F.col("n_nationkey") < 20, F.col("n_name")).otherwise(F.raise_error(F.lit("torn")))))
        kept = False
    except Exception:  # noqa: BLE001  whatever a failing job raises
        kept = cache.manifest("k") == mark and cache.get("k").count() == rows.count()
    old = cache.get("k")
    cache.put("k", cache.get("k").where("n_regionkey > 0"))
    readable = old.count() == rows.count() and cache.manifest("k") is None
    return cache.get("k").select("*", F.lit(kept).alias("kept"), F.lit(readable).alias("old_readable"), F.lit(len(cache.versions("k"))).alias("versions"))


def emitted(spark: SparkSession, rows: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """What the sink prints, line by line, as (place, names)."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.emit(cli.ordered(rows, kind), None)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    return spark.createDataFrame([(i, *(str(x.get(n)) for n in names)) for i, x in enumerate(lines, 1)], "place int, " + ", ".join(f"{n} string" for n in names))


@query("emit_lanes", f"select cast(row_number() over (order by decision_date, theme) as integer) as place, cast(decision_date as varchar) as decision_date, theme, status from ({lane_sql('current_leader_easy')})")
def emit_lanes(spark, sf_dir):
    rows = lanes.current_leader(cached_metrics(spark, sf_dir), EASY_LEADER)
    return emitted(spark, rows.select("decision_date", "theme", "status"), "signals", ["decision_date", "theme", "status"])


def cached_metrics(spark, sf_dir) -> DataFrame:
    from fathomline.queries import _metrics

    return _metrics(spark, sf_dir)


@query("emit_annual", f"select cast(row_number() over (order by year, rank, theme) as integer) as place, cast(year as varchar) as year, cast(rank as varchar) as rank, theme from ({annual_sql(EASY_ANNUAL)})")
def emit_annual(spark, sf_dir):
    return emitted(spark, annual.annual_theme_leaders(lineitem_panel(spark, sf_dir), EASY_ANNUAL).select("year", "rank", "theme"), "annual", ["year", "rank", "theme"])


@query("emit_scorecard", f"select cast(row_number() over (order by score desc, entity) as integer) as place, entity from ({lane_sql('scorecard')})")
def emit_scorecard(spark, sf_dir):
    return emitted(spark, scorecard.scorecard(entity_records(spark, sf_dir), TODAY).select("score", "entity"), "score", ["entity"])


@query(
    "annual_demo",
    """select cast(date '2022-01-07' + cast(7 * n as integer) as timestamp) as date, theme, security, round(100 * pow(1 + early, least(n + 1, turn)) * pow(1 + late, greatest(n + 1 - turn, 0)), 6) + 0.0 as value from range(150) r(n),
        (values ('__market__', 'SPY', 0.002::double, 150, 0.002::double), ('태양광', '태양광', 0.001, 65, 0.018), ('반도체', '반도체', 0.004, 95, 0.014), ('양자컴퓨팅', '양자컴퓨팅', 0.001, 120, 0.022)) v(theme, security, early, turn, late)
        union all select cast(date as timestamp), theme, security, round(value, 6) + 0.0 from ("""
    + with_panel("select date, theme, security, value from series")
    + ")",
)
def annual_demo(spark, sf_dir):
    """The demo's prices beside those of lineitem, as one panel that an annual run can take."""
    own = cli.annual_demo(spark).select(F.col("date").cast("timestamp_ntz").alias("date"), "theme", "security", "value")
    return own.union(lineitem_panel(spark, sf_dir).select(F.col("date").cast("timestamp_ntz"), "theme", "security", "value"))


# --- scorecards ---

LANE_ROWS = [("current_leader_easy", "Current Leader", "current_leader", "leader_score", "rs_rank_13w", "null"), ("emerging_radar_easy", "Emerging Radar", "emerging_radar", "radar_score", "coalesce(rs_rank_13w, rs_rank_4w, acceleration_rank)", "null")]
LANE_ROWS += [("hold_candidate_easy", "12M Hold Candidate", "hold_candidate_12m", "candidate_score", "coalesce(rs_rank_13w, candidate_score)", "annualized_volatility_26w")]


def _unit(x: str, default: str) -> str:
    return f"least(greatest(case when abs(coalesce({x}, {default})) <= 1.5 then coalesce({x}, {default}) * 100 else coalesce({x}, {default}) end, 0), 100)"


def lane_scorecard_sql() -> str:
    parts = []
    for name, bucket, engine, score, momentum, vol in LANE_ROWS:
        own = _unit(score, "0")
        breadth = "coalesce(breadth_average, " + ("breadth_4w, breadth_13w" if engine == "emerging_radar" else "breadth_13w") + ")"
        parts.append(
            f"select theme as entity, '{bucket}' as bucket, '{engine}' as engine, status, warnings, decision_date as as_of, coalesce(history_weeks, 0) as history, {own} as sc, {_unit(momentum, own)} as mo, {_unit(breadth, '50')} as br, cast({vol} as double) as vol "
            f"from ({lane_sql(name)}) where decision_date <= (select max(l_shipdate) from lineitem) qualify row_number() over (partition by theme order by decision_date desc) = 1"
        )
    return f"""with u as ({' union all '.join(parts)}),
        a as (select *, cast(greatest(date '2002-01-01' - as_of, 0) as integer) as age, list_filter(string_split(warnings, '; '), lambda x: x <> '') as named from u),
        b as (select *, case when len(named) > 0 then named when status in ('insufficient_history', 'warning', 'risk_rejected', 'awaiting_confirmation') then [status] else ['none flagged'] end as base from a),
        c as (select *, case when age > 45 and not list_contains(base, 'stale data') then list_append(base, 'stale data') else base end as flags from b),
        d as (select *, least(1, history / 52) * case when array_to_string(flags, ';') <> 'none flagged' then 0.85::double else 1 end as conf from c)
        select entity, round(sc, 2) + 0.0 as score, bucket, engine, status, round(mo, 2) + 0.0 as momentum, round(br, 2) + 0.0 as breadth, round(least(history / 52 * 100, 100), 2) + 0.0 as quality, round(case when vol is null then 75 else least(greatest(100 - vol * 100, 0), 100) end, 2) + 0.0 as risk_control,
            round(conf * 100, 1) + 0.0 as data_confidence, round(conf, 3) + 0.0 as confidence, case when conf >= 0.8 then 'High' when conf >= 0.55 then 'Medium' else 'Low' end as confidence_label, array_to_string(flags, '; ') as risk_flags, as_of, age as freshness_days,
            case when history > 0 then cast(history as bigint) end as observations, '{scorecard.DISCLAIMER}' as disclaimer from d"""


@query("lane_scorecard", lane_scorecard_sql())
def lane_scorecard(spark, sf_dir):
    run = pipeline.run_signal_pipeline(lineitem_panel(spark, sf_dir), None, EASY_LEADER, EASY_RADAR, EASY_HOLD, keep=written)
    return scorecard.lane_scorecard(run.current_leader, run.emerging_radar, run.hold_candidate, TODAY)


@query(
    "scorecard_file",
    f"""select case when n_nationkey % 3 = 0 then 'Unknown' else n_name end as entity, s as score, s as signal_score, case when n_nationkey % 4 = 0 then 'Emerging Radar' when s >= 70 then 'Current Leader' when s >= 50 then 'Emerging Radar' else '12M Hold Candidate' end as bucket,
        case when n_nationkey % 4 = 0 then 'emerging_radar' when s >= 70 then 'current_leader' when s >= 50 then 'emerging_radar' else 'hold_candidate_12m' end as engine, s as momentum, s as breadth, s as quality, s as risk_control,
        case when n_nationkey % 2 = 0 then 80 else 50 end::double as data_confidence, case when n_nationkey % 2 = 0 then 0.8 else 0.5 end::double as confidence, case when n_nationkey % 2 = 0 then 'High' else 'Low' end as confidence_label,
        'none flagged' as risk_flags, date '2024-01-05' as as_of, cast(null as integer) as freshness_days, cast(null as bigint) as observations, '{scorecard.DISCLAIMER}' as disclaimer from (select *, n_nationkey * 4.0::double as s from nation)""",
)
def scorecard_file(spark, sf_dir):
    """A file that has scores and little else."""
    path, n = scratch(spark), F.col("n_nationkey")
    bucket = F.when(n % 4 == 0, "Emerging Radar")
    table(spark, sf_dir, "nation").select(F.when(n % 3 != 0, F.col("n_name")).alias("theme"), (n * 4.0).alias("Score"), bucket.alias("bucket"), F.when(n % 2 == 0, 0.8).alias("confidence"), F.lit("2024-01-05").alias("date")).write.option("header", True).csv(path)
    return scorecards.load_scorecard(spark, path, TODAY)[0]


@query(
    "scorecard_demo",
    "select entity, score, bucket, momentum, breadth, quality, risk_control, confidence, risk_flags, as_of, freshness_days, observations from (values ('AI Infrastructure', 86.4::double, 'Current Leader', 88.0::double, 84.0::double, 91.0::double, 79.0::double, 0.88::double, 'none flagged'), "
    "('Cybersecurity', 66.8, 'Emerging Radar', 73.0, 65.0, 70.0, 53.0, 0.71, 'valuation sensitivity'), ('Grid Modernization', 44.7, '12M Hold Candidate', 43.0, 56.0, 63.0, 18.0, 0.58, 'high volatility; sparse history')) v(entity, score, bucket, momentum, breadth, quality, risk_control, confidence, risk_flags), "
    "(select date '2001-12-30' as as_of, 2 as freshness_days, 24::bigint as observations)",
)
def scorecard_demo(spark, sf_dir):
    """What a file gives in which nothing can be scored: here, all orders' priorities, which are no numbers."""
    path = scratch(spark)
    table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).write.option("header", True).csv(path)
    rows, _ = scorecards.load_scorecard(spark, path, TODAY)
    return rows.select("entity", "score", "bucket", "momentum", "breadth", "quality", "risk_control", "confidence", "risk_flags", "as_of", "freshness_days", "observations")


# --- guards ---


def guard_of(spark, prices: DataFrame, as_of: str | None = None) -> tuple[str, str]:
    try:
        return "ok", str(pipeline.checked_as_of(prices, as_of).date())
    except pipeline.PipelineError as error:
        return type(error).__name__, str(error).split()[0]


@query(
    "pipeline_guards",
    """with n as (select count(*) as all_, count(*) filter (event_id % 9 = 0) as ninth from events), d as (select cast(max(ts) as date) as last from events)
    select 'plain' as input, 'ok' as outcome, cast(last as varchar) as detail from d union all select 'late', 'AvailabilityError', cast(all_ as varchar) from n union all select 'unknown', 'AvailabilityError', cast(ninth as varchar) from n
    union all select 'unread', 'PipelineError', cast(ninth as varchar) from n union all select 'empty', 'PipelineError', 'there' union all select 'before', 'PipelineError', 'no' union all select 'in time', 'ok', '2030-01-01' union all select 'second column', 'ok', cast(last as varchar) from d""",
)
def pipeline_guards(spark, sf_dir):
    """What a run refuses: prices known too late, or with nothing that says when; dates that can't be read; nothing at all, or nothing by the as-of day."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("theme"), F.col("user_id").alias("security"), "value", "event_id")
    ninth = F.col("event_id") % 9 == 0
    early, late = F.col("date").cast("date").cast("timestamp_ntz"), F.date_add(F.col("date").cast("date"), 1).cast("timestamp_ntz")
    inputs = {
        "plain": (rows, None),
        "late": (rows.withColumn("available_at", late), None),
        "unknown": (rows.withColumn("evidence_available_at", F.when(~ninth, early)), None),
        "unread": (rows.withColumn("date", F.when(ninth, "soon").otherwise(F.col("date").cast("string"))), None),
        "empty": (rows.limit(0), None),
        "before": (rows, "1970-01-01"),
        "in time": (rows.withColumn("feature_available_at", early), "2030-01-01"),
        "second column": (rows.withColumns({"evidence_available_at": early, "available_at": late}), None),
    }
    return spark.createDataFrame([(name, *guard_of(spark, *given)) for name, given in inputs.items()], "input string, outcome string, detail string")


@query("no_lookahead", f"with {MEMBERS}, d as (select unnest([date '1993-01-01', date '1998-01-15', date '2010-01-01']) as day) select cast(day as varchar) as day, exists (select * from m where evidence_available_at > day) as raised, (select count(*) from m where valid_from <= day and (valid_to is null or day < valid_to) and evidence_available_at <= day) as members from d")
def no_lookahead(spark, sf_dir):
    rows, out = membership_table(spark, sf_dir), []
    for day in ("1993-01-01", "1998-01-15", "2010-01-01"):
        try:
            membership.assert_no_lookahead(rows, day)
            raised = False
        except membership.LookaheadError:
            raised = True
        out.append((day, raised, membership.memberships_as_of(rows, day).count()))
    return spark.createDataFrame(out, "day string, raised boolean, members bigint")


@query("annual_leaders_as_of", annual_sql(EASY_ANNUAL, AS_OF))
def annual_leaders_as_of(spark, sf_dir):
    return annual.annual_theme_leaders(lineitem_panel(spark, sf_dir), EASY_ANNUAL, AS_OF)


# --- audits with their examples ---

KEY = "concat_ws('|', strftime(d, '%Y-%m-%d %H:%M:%S'), symbol)"


def audit_sql(rules: list[tuple[str, str]], joins: str = "") -> str:
    return " union all ".join(f"select '{code}' as code, count(*) as count, array_to_string(list_sort(list(k order by k)[1:5]), ', ') as examples from (select {KEY} as k from f {joins} where {rule})" for code, rule in rules)


def shown(found: DataFrame) -> DataFrame:
    return found.select("code", "count", F.array_join("examples", ", ").alias("examples"))


AUDIT_RULES = [("invalid_feature_timestamp", "a is null or d is null"), ("feature_after_decision", "a > d"), ("missing_membership_date", "ms is null"), ("membership_out_of_range", "ms is not null and (d < ms or coalesce(d > me, false))")]


@query("audit_examples", f"with {FEATURES} select * from ({audit_sql(AUDIT_RULES)}) where count > 0")
def audit_examples(spark, sf_dir):
    rows = feature_table(spark, sf_dir)
    return shown(audits.issues(rows, audits.availability_checks(rows) | audits.membership_checks(rows)))


INCEPTIONS = "i as (select cast(p_partkey as varchar) as symbol, case when p_partkey % 17 <> 0 then date '1992-01-01' + cast(p_partkey % 2000 as integer) end as since from part)"


def inceptions(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.cast("string").alias("symbol"), F.when(key % 17 != 0, F.date_add(F.lit("1992-01-01").cast("date"), (key % 2000).cast("int"))).alias("inception"))


INCEPTION_RULES = [("missing_etf_inception", "since is null"), ("before_etf_inception", "d < since")]


@query("audit_inception", f"with {FEATURES}, {INCEPTIONS} select * from ({audit_sql(INCEPTION_RULES, 'left join i using (symbol)')}) where count > 0")
def audit_inception(spark, sf_dir):
    """Decisions before a fund began, by a table of inceptions that is looked up by symbol."""
    rows = audits.joined_metadata(feature_table(spark, sf_dir), inceptions(spark, sf_dir), {"inception": "etf_inception"})
    return shown(audits.issues(rows, audits.inception_checks(rows)))


@query("audit_history_from_inception", f"with {FEATURES} select 'insufficient_etf_history' as code, count(*) as count from f where d < ms + interval 182 days")
def audit_history_from_inception(spark, sf_dir):
    rows = feature_table(spark, sf_dir).drop("history_weeks").withColumnRenamed("membership_start", "etf_inception")
    return audits.issues(rows, audits.history_checks(rows)).select("code", "count")


@query(
    "audit_integrity",
    f"with {FEATURES}, {INCEPTIONS} select * from ({audit_sql([*AUDIT_RULES, *INCEPTION_RULES, ('insufficient_etf_history', 'etf and (h is null or h < 26)'), ('insufficient_coverage', 'coverage is null or coverage < 0.95::double')], 'left join i using (symbol)')} "
    f"union all select 'duplicate_feature_key', sum(n)::bigint, array_to_string(list(k order by k)[1:5], ', ') from (select {KEY} as k, count(*) as n from f group by d, symbol having count(*) > 1)) where count > 0",
)
def audit_integrity(spark, sf_dir):
    return shown(audits.audit_integrity(feature_table(spark, sf_dir), inceptions=inceptions(spark, sf_dir)))


# --- look-ups, labels and rank metrics ---


@query("price_at_or_before", "with a as (select o_orderstatus as theme, o_orderkey, cast(o_orderdate as timestamp) as asked from orders), p as (select o_orderstatus as theme, cast(o_orderdate as timestamp) as ts, avg(cast(o_totalprice as double)) as price from orders where o_orderkey % 5 = 0 group by all) select a.theme, o_orderkey, asked, round(price, 4) + 0.0 as found from a asof left join p on a.theme = p.theme and a.asked >= p.ts")
def price_at_or_before(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("theme"), "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("asked"), F.col("o_totalprice").cast("double").alias("price"))
    series = orders.where("o_orderkey % 5 = 0").groupBy("theme", F.col("asked").alias("ts")).agg(F.avg("price").alias("price"))
    return early_hits.price_at_or_before(orders.drop("price"), series, "asked", "found").withColumn("found", F.round("found", 4))


@query(
    "parent_sector_labels",
    with_panel(
        f"{forward_sql((26,)).replace(SERIES, SERIES + ', parents as (select ts, avg(price) as parent from s group by ts)').lstrip()}, z as (select *, {gains_sql(26)} from y) select z.ts as decision_at, z.theme, round(g26 - (x.parent / e.parent - 1), 6) + 0.0 as future_26w_parent_sector_excess_return "
        "from z left join parents e on e.ts = z.entry.ts left join parents x on x.ts = z.exit_26.ts"
    ),
)
def parent_sector_labels(spark, sf_dir):
    series = index_series(spark, sf_dir)
    parents = series.dropna(subset=["price", "b_price"]).groupBy("ts").agg(F.avg("price").alias("parent_price"))
    return labels.future_labels(series.join(parents, "ts", "left"), (26,), drawdown=False).select("decision_at", "theme", "future_26w_parent_sector_excess_return")


FREE = EpisodeConfig(require_breadth=False, require_min_names=False, major_return=0.5, major_excess=0.2, explosive_return=0.9, min_rank=0.5)


@query(
    "classify_without_breadth",
    """with m as (select l_orderkey, l_linenumber, l_discount * 15 as t, l_tax * 5 as s, case when l_returnflag = 'A' then l_quantity / 50 end as rk from lineitem), k as (select *, t >= 0.5::double and t - s >= 0.2::double and coalesce(rk >= 0.5::double, true) as major_surge from m)
    select l_orderkey, l_linenumber, true as breadth_ok, true as min_names_ok, major_surge, major_surge and t >= 0.9::double as explosive from k""",
)
def classify_without_breadth(spark, sf_dir):
    return labels.classify_moves(move_table(spark, sf_dir), FREE).select("l_orderkey", "l_linenumber", "breadth_ok", "min_names_ok", "major_surge", "explosive")


PEARSON = f"{SCORES}, c as (select date, covar_samp(score, outcome) / nullif(stddev_samp(score) * stddev_samp(outcome), 0) as ic, count(*) as n from v group by date)"


@query("pearson_ic", with_panel(f"{PEARSON} select d.date, round(case when n >= 3 then ic end, 6) + 0.0 as rank_ic, coalesce(n, 0) as n from (select distinct date from p) d left join c using (date)", "p_brand"))
def pearson_ic(spark, sf_dir):
    return rank_metrics.rank_ic_by_date(*score_tables(spark, sf_dir), method="pearson")


@query(
    "rank_metrics_summary",
    f"select * from ({lane_sql('rank_ic_summary')}), ({lane_sql('top_bottom_summary')})",
)
def rank_metrics_summary(spark, sf_dir):
    return rank_metrics.evaluate_rank_metrics(*score_tables(spark, sf_dir))


@query(
    "top_bottom_against_benchmark",
    with_panel(
        f"""{SCORES.replace('from metrics)', 'from metrics), w as (select week as date, b_ret * 2 as half from bench)').replace('v as (select * from p where', 'q as (select p.date, asset, score, outcome - half as outcome from p left join w using (date)), v as (select * from q where')},
        a as (select *, row_number() over (partition by date order by score desc, asset) as down, row_number() over (partition by date order by score asc, asset) as up, count(*) over (partition by date) as n from v),
        m as (select date, max(n) as n, avg(outcome) as universe_mean, avg(outcome) filter (down <= greatest(1, ceil(n * 0.3::double))) as top_mean, avg(outcome) filter (up <= greatest(1, ceil(n * 0.1::double))) as bottom_mean from a group by date)
        select d.date, round(case when n >= 3 then top_mean end, 6) + 0.0 as top_mean, round(case when n >= 3 then bottom_mean end, 6) + 0.0 as bottom_mean, round(case when n >= 3 then universe_mean end, 6) + 0.0 as universe_mean from (select distinct date from p) d left join m using (date)""",
        "p_brand",
    ),
)
def top_bottom_against_benchmark(spark, sf_dir):
    scores, returns = score_tables(spark, sf_dir)
    bench = _panel(spark, sf_dir, "p_brand").benchmark.select(F.col("week").alias("date"), (F.col("b_ret") * 2).alias("benchmark_return"))
    return rank_metrics.buckets_by_date(scores, returns, bench, 0.3, 0.1).select("date", "top_mean", "bottom_mean", "universe_mean")


@query(
    "two_benchmark_themes",
    with_panel("select week, round(b_price, 6) + 0.0 as b_price, round(b_ret, 6) + 0.0 as b_ret from bench").replace(
        "px as (", "more as (select * from series union all select date, week, 'other', security, value * 1.5 from series where security = 'SPY' and extract(week from week) % 2 = 0 union all select date, week, 'third', security, value * 0.5 from series where security = 'SPY' and extract(week from week) % 3 = 0), px as ("
    ).replace("as price from series where value > 0", "as price from more where value > 0"),
)
def two_benchmark_themes(spark, sf_dir):
    """Weeks in which one, two or three themes hold the benchmark: its price is their median."""
    prices = lineitem_panel(spark, sf_dir)
    week, spy = F.weekofyear(F.next_day(F.date_sub(F.to_date("date"), 1), "FRI")), prices.where("security = 'SPY'")
    more = prices.union(spy.where(week % 2 == 0).select("date", F.lit("other"), "security", F.col("value") * 1.5)).union(spy.where(week % 3 == 0).select("date", F.lit("third"), "security", F.col("value") * 0.5))
    return panel.Panel(more, PanelConfig()).benchmark.select("week", "b_price", "b_ret")


@query("split_features", "with w as (" + lane_sql("walk_forward") + ") select split_id, count(*) filter (role = 'train') as train, count(*) filter (role = 'test') as test from w group by split_id")
def split_features(spark, sf_dir):
    """The splitter's folds one after the other, as a training loop sees them."""
    dates = panel.weeks(_panel(spark, sf_dir).observed).select(F.col("week").cast("timestamp_ntz").alias("date"), F.date_add("week", 91).cast("timestamp_ntz").alias("label_end"))
    folds = splits.PurgedWalkForwardSplit(SplitConfig(n_splits=4, test_size=20, train_size=150, embargo=4, min_train_size=10)).split(dates)
    return spark.createDataFrame([(i, train.count(), test.count()) for i, (train, test) in enumerate(folds)], "split_id int, train bigint, test bigint")

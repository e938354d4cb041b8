"""The catalog: themes and sources (YAML), memberships (CSV)."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.parsing import confidence
from fathomline.operators.membership import theme_counts, unknown_themes
from fathomline.sources import files
from fathomline.sources.readers import read_rows

THEME = "theme_id string, name string, description string, category string, is_negative_control boolean, historical_data_status string"
SOURCE = "source_id string, uri string, sha256 string, retrieved_at string, evidence_available_at string, content_type string, row_count bigint, complete boolean, redistributable boolean, notes string"
REQUIRED = ("theme_id", "permanent_id", "symbol", "valid_from", "evidence_available_at", "exposure_tier", "confidence")
DATES = ("valid_from", "valid_to", "evidence_available_at", "listing_date", "delisting_date", "data_coverage_from", "data_coverage_to")


class CatalogError(ValueError):
    """The catalog's tables don't fit together."""


def scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    plain = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def simple_yaml(text: str) -> dict:
    """Top-level `key: value` pairs and lists of flat mappings, which is all that catalogs use."""
    out: dict = {}
    items: list | None = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        if line[0] not in " -":
            key, _, value = body.partition(":")
            items = [] if not value.strip() else None
            out[key.strip()] = items if items is not None else scalar(value)
            continue
        if items is None:
            raise CatalogError(f"unexpected line: {raw!r}")
        if body.startswith("- "):
            items.append({})
            body = body[2:].strip()
        key, _, value = body.partition(":")
        items[-1][key.strip()] = scalar(value)
    return out


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) if r.get(n) is None or not n.endswith("_at") else str(r[n]) for n in names) for r in rows], schema)


@dataclass
class Catalog:
    themes: DataFrame
    memberships: DataFrame
    sources: DataFrame

    def negative_controls(self) -> DataFrame:
        return self.themes.where("is_negative_control")

    def theme(self, theme_id: str) -> DataFrame:
        return self.themes.where(F.col("theme_id") == theme_id)


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    missing = [n for n in REQUIRED if n not in rows.columns]
    if missing:
        raise CatalogError(f"memberships lack {', '.join(missing)}")
    return rows.withColumns({n: F.to_date(n) for n in DATES if n in rows.columns} | {"confidence": confidence(F.col("confidence")), "symbol": F.upper(F.trim("symbol"))})


def load_catalog(spark: SparkSession, folder: str) -> Catalog:
    """themes.yaml, memberships.csv and, if there is one, sources.yaml, on any file system that Spark reaches. Themes that memberships name must exist. The YAML files are small and read by the driver."""
    text = lambda name: files.read_text(spark, f"{folder}/{name}") or ""
    themes = _frame(spark, simple_yaml(text("themes.yaml")).get("themes") or [], THEME)
    sources = _frame(spark, simple_yaml(text("sources.yaml")).get("sources") or [], SOURCE)
    memberships = read_memberships(spark, f"{folder}/memberships.csv")
    unknown = [r[0] for r in unknown_themes(memberships, themes).select("theme_id").distinct().limit(5).collect()]
    if unknown:
        raise CatalogError(f"memberships of unknown themes: {', '.join(sorted(unknown))}")
    return Catalog(themes, memberships, sources)


#: What is listed where there's no catalog.
FALLBACK = [("AI Infrastructure", "Current Leader"), ("Cybersecurity", "Emerging Radar"), ("Grid Modernization", "12M Hold Candidate")]
CATALOG_FOLDERS, ROW_FILES = ("data/catalog", "catalog"), (".csv", ".json", ".jsonl")


def search_folders(roots: list[str | Path] | None = None) -> list[str]:
    """Where a catalog may lie under the roots: the working folder and this package's, if none are given. Each once. Roots with a scheme stay as they are, others are folders of the driver's machine."""
    roots = [Path.cwd(), Path(__file__).resolve().parents[2], Path(__file__).resolve().parents[1]] if roots is None else roots
    root = lambda x: x.rstrip("/") if isinstance(x, str) and "://" in x else f"file://{Path(x).resolve()}"
    return list(dict.fromkeys(f"{root(x)}/{name}" for x in roots for name in CATALOG_FOLDERS))


def first_row_file(spark: SparkSession, folder: str) -> str | None:
    return next((f"{folder}/{name}" for name in files.names(spark, folder) if name.lower().endswith(ROW_FILES)), None)


def catalog_items(spark: SparkSession, path: str | None = None, roots: list[str | Path] | None = None) -> tuple[DataFrame, str]:
    """(what a catalog lists, where it is from). A folder with themes.yaml and memberships.csv gives its themes with the number of their members; else the first file of rows in a folder, or the file that is named, is listed as it is; else FALLBACK.

    Without a path the search folders are tried in turn. A catalog that doesn't fit together doesn't stop the listing. Paths may be on any file system that Spark reaches, and files may be folders of parts that Spark has written.
    """
    named = path is not None and path.lower().endswith(ROW_FILES)
    folders = ([path.rstrip("/")] if files.is_folder(spark, path) and not named else []) if path else search_folders(roots)
    for folder in folders:
        if all(files.exists(spark, f"{folder}/{name}") for name in ("themes.yaml", "memberships.csv")):
            try:
                own = load_catalog(spark, folder)
            except (CatalogError, PySparkException):
                continue
            items = theme_counts(own.themes, own.memberships).withColumnRenamed("members", "memberships")
            if not items.isEmpty():
                return items.withColumns({"theme": F.coalesce("name", "theme_id"), "source": F.lit(folder)}), f"{folder}/themes.yaml"
    found = [path] if path and not folders and files.exists(spark, path) else [f for f in (first_row_file(spark, x) for x in folders) if f]
    for file in found[:1]:
        try:
            rows = read_rows(spark, file)
            if not rows.isEmpty():
                return (rows if "source" in rows.columns else rows.withColumn("source", F.lit(file))), file
        except (OSError, ValueError, PySparkException):
            pass
    return spark.createDataFrame([(t, lane, "demo") for t, lane in FALLBACK], "theme string, lane string, source string"), "demo"

"""Readers, catalog, provenance, providers, scorecard, command line, streaming."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline import cli
from fathomline.config import Clock
from fathomline.functions.parsing import safe_date, safe_number
from fathomline.operators import panel, scorecard
from fathomline.sources import catalog, challenges, provenance, providers, readers, scorecards
from fathomline.streaming.weekly import late_arrivals_stream, weekly_last_stream


def test_numbers_and_dates(spark):
    texts = ["1,234.5", "$7", "50%", "n/a", "inf", "x", None, " -3 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", safe_number(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [1234.5, 7.0, 0.5, None, None, None, None, -3.0]
    dates = ["2024-01-05", "2024-01-05T10:00:00Z", "2024/01/05", "20240105", "01/05/2024", "31/12/2024", "soon"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(dates)], "i int, t string").select("i", safe_date(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v and r.v.date().isoformat() for r in got] == ["2024-01-05"] * 5 + ["2024-12-31", None] and got[1].v.hour == 10


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿date;ticker;Theme;close\n2024-01-05;aa;t;$1,5\n;;;\n2024-01-12;bb;t;x\n", encoding="utf-8")
    rows = readers.read_rows(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["date", "ticker", "Theme", "close"] and rows.count() == 2
    assert [(r.security, r.value) for r in readers.tidy_panel(rows).collect()] == [("aa", 15.0)]
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"date": "2024-01-05", "symbol": "q", "value": 2}]}))
    assert [(r.entity, r.value) for r in readers.normalised_records(readers.read_rows(spark, str(tmp_path / "b.json"))).collect()] == [("q", 2.0)]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_rows(spark, str(tmp_path / "c.jsonl")).collect() if r.a) == [1, 2]
    (tmp_path / "d.csv").write_text("date,x,y\n2024-01-05,1,2\n2024-01-12,3,\n")
    wide = readers.normalised_records(readers.read_rows(spark, str(tmp_path / "d.csv"))).collect()
    assert sorted((r.entity, r.value) for r in wide) == [("x", 1.0), ("x", 3.0), ("y", 2.0)]
    assert readers.tidy_panel(readers.read_rows(spark, str(tmp_path / "d.csv"))) is None


def test_price_observations(spark, tmp_path):
    (tmp_path / "p.csv").write_text("permanent_id,symbol,date,evidence_available_at,close,source\nid1,AA,2024-01-01,2024-01-01,1,s\nid1,AA,2024-01-02,2024-02-01,2,s\n,BB,2024-01-03,,3,\n")
    own = providers.FilePriceProvider(spark, str(tmp_path / "p.csv"))
    assert [r.value for r in own.get_prices("aa", "2024-01-01", "2024-01-31").collect()] == [1.0, 2.0]
    assert [r.value for r in own.history("ID1", "2024-01-01", "2024-01-31", as_of="2024-01-15").collect()] == [1.0]
    other = own.get_prices("ticker:bb", "2024-01-01", "2024-01-31").collect()
    assert [(r.value, r.complete) for r in other] == [(3.0, False)]
    with pytest.raises(ValueError, match="invalid price row"):
        readers.price_observations(readers.read_rows(spark, str(tmp_path / "p.csv")).withColumn("close", F.lit("bad")))


def test_network_gate(spark, monkeypatch):
    monkeypatch.delenv(providers.NetworkPriceProvider.VARIABLE, raising=False)
    with pytest.raises(providers.ProviderDisabled):
        providers.NetworkPriceProvider(spark).get_prices("x", "2024-01-01", "2024-01-02")

    class Own(providers.NetworkPriceProvider):
        def connector(self):
            def fetch(symbol, start, end_exclusive):
                if symbol == "BAD":
                    raise KeyError("no such symbol")
                return [(start, 1), (date.fromordinal(end_exclusive.toordinal() - 1), len(symbol))]

            return fetch

    own = Own(spark, enabled=True, today=date(2024, 6, 1), days=10)
    assert [tuple(r) for r in own.get_prices("ticker:aa", "2024-01-01", "2024-01-02").collect()] == [("ticker:aa", "AA", date(2024, 1, d), date(2024, 6, 1), float(d)) for d in (1, 2)]
    assert own.get_prices("ticker:aa", "2024-01-01", "2024-01-02", as_of="2024-05-01").count() == 0
    assert own.get_prices("ticker:bad", "2024-01-01", "2024-01-02", as_of="2024-05-01").count() == 0  # nothing is fetched
    assert own.get_prices("ticker:aa", "2024-01-02", "2024-01-01").count() == 0
    many = own.prices_of(["ticker:aa", "b", "ticker:aa"], "2024-01-01", "2024-01-25")
    assert many.rdd.getNumPartitions() == 6 and many.groupBy("symbol").count().orderBy("symbol").collect() == [("AA", 6), ("B", 6)]
    with pytest.raises(Exception, match="BAD from 2024-01-01 to before 2024-01-03: KeyError"):
        own.get_prices("ticker:bad", "2024-01-01", "2024-01-02").collect()


def test_catalog(spark, tmp_path):
    (tmp_path / "themes.yaml").write_text("version: 1\nthemes:\n  - theme_id: solar\n    name: 'Solar energy'\n    is_negative_control: false\n  - theme_id: none\n    name: Control  # note\n    is_negative_control: true\n")
    head = "theme_id,permanent_id,symbol,valid_from,valid_to,evidence_available_at,exposure_tier,confidence\n"
    (tmp_path / "memberships.csv").write_text(head + "solar,ticker:a,a,2020-01-01,,2020-01-01,core,high\nsolar,ticker:b,b,2020-01-01,2021-01-01,2020-01-01,core,0.5\n")
    own = catalog.load_catalog(spark, str(tmp_path))
    assert [r.theme_id for r in own.negative_controls().collect()] == ["none"] and own.theme("solar").first().name == "Solar energy"
    assert sorted((r.symbol, r.confidence) for r in own.memberships.collect()) == [("A", 0.9), ("B", 0.5)] and own.sources.count() == 0
    (tmp_path / "memberships.csv").write_text(head + "wind,ticker:a,a,2020-01-01,,2020-01-01,core,high\n")
    with pytest.raises(catalog.CatalogError, match="wind"):
        catalog.load_catalog(spark, str(tmp_path))


def test_catalog_items(spark, tmp_path):
    items, source = catalog.catalog_items(spark, None, [tmp_path])
    assert source == "demo" and items.count() == 3
    own = tmp_path / "catalog"
    own.mkdir()
    (own / "b.csv").write_text("theme,lane\nx,y\n")
    items, source = catalog.catalog_items(spark, None, [tmp_path])
    assert source.endswith("b.csv") and items.first().asDict() == {"theme": "x", "lane": "y", "source": source}
    (own / "themes.yaml").write_text("themes:\n  - theme_id: solar\n    name: Solar\n")
    head = "theme_id,permanent_id,symbol,valid_from,valid_to,evidence_available_at,exposure_tier,confidence\n"
    (own / "memberships.csv").write_text(head + "wind,ticker:a,a,2020-01-01,,2020-01-01,core,high\n")
    assert catalog.catalog_items(spark, str(own))[1].endswith("b.csv")  # a draft that doesn't fit together
    (own / "memberships.csv").write_text(head + "solar,ticker:a,a,2020-01-01,,2020-01-01,core,high\n")
    items, source = catalog.catalog_items(spark, str(own))
    assert source.endswith("themes.yaml") and [(r.theme, r.memberships) for r in items.collect()] == [("Solar", 1)]


def test_scorecard_files(spark, tmp_path):
    clock = Clock(date(2024, 2, 1))
    (tmp_path / "s.json").write_text(json.dumps([{"symbol": "q", "score": "71.456", "data_confidence": 60}, {"score": None, "bucket": "12M Hold Candidate", "momentum": 3}]))
    rows = {r.entity: r for r in scorecards.load_scorecard(spark, str(tmp_path / "s.json"), clock)[0].collect()}
    assert (rows["q"].bucket, rows["q"].engine, rows["q"].momentum, rows["q"].confidence, rows["q"].confidence_label) == ("Current Leader", "current_leader", 71.46, 0.6, "Medium")
    assert (rows["Unknown"].score, rows["Unknown"].momentum, rows["Unknown"].breadth, rows["Unknown"].confidence) == (0.0, 3.0, 0.0, 0.5)
    (tmp_path / "w.csv").write_text("date,x,y\n2024-01-05,1,2\n2024-01-12,3,4\n")
    rows, source = scorecards.load_scorecard(spark, str(tmp_path / "w.csv"), clock)
    assert {r.entity for r in rows.collect()} == {"x", "y"} and source.endswith("w.csv") and rows.columns == scorecards.FIELDS
    demo, source = scorecards.load_scorecard(spark, str(tmp_path / "none.csv"), clock)
    assert demo.count() == 3 and source.startswith("demo")
    prices = [(date(2020, 1, 3) + timedelta(weeks=i), t, s, 100.0 * r**i) for i in range(60) for t, s, r in (("up", "a", 1.01), ("down", "b", 0.99), ("m", "SPY", 1.0))]
    spark.createDataFrame(prices, "date date, theme string, ticker string, close double").write.option("header", True).csv(str(tmp_path / "tidy"))
    rows = scorecards.load_scorecard(spark, str(tmp_path / "tidy"), clock)[0].collect()
    assert {(r.entity, r.engine) for r in rows} == {(t, e) for t in ("up", "down") for e in scorecards.ENGINES}


def test_challenges(spark):
    cases = challenges.challenge_cases(spark)
    challenges.validate_challenges(cases)
    assert cases.count() == 14 and challenges.challenge_cases(spark, False).where("expected_positive").count() == 5
    assert challenges.challenge_case(spark, "cannabis")["case_type"] == "negative_control"
    assert challenges.challenge_case(spark, "evtol_2024")["case_type"] == "concentration_stress" and challenges.challenge_case(spark, "spac")["is_negative_control"]
    with pytest.raises(KeyError):
        challenges.challenge_case(spark, "none")
    with pytest.raises(ValueError):
        challenges.validate_challenges(cases.union(cases))


def test_provenance(spark, tmp_path):
    payload = b"hello"
    (tmp_path / "f.bin").write_bytes(payload)
    mark = provenance.file_checksums(spark, str(tmp_path / "f.bin")).first()
    manifest = provenance.SourceManifest("s", "u", mark.sha256, "2024-01-01", "2024-01-01")
    assert manifest.verify(payload) and not manifest.verify(b"x") and not provenance.SourceManifest("s", "u", None, "2024-01-01", "2024-01-01").verify(payload)
    with pytest.raises(ValueError):
        provenance.SourceManifest("s", "u", "xyz", "2024-01-01", "2024-01-01")
    memory = provenance.MemoryCache()
    memory.put("k", 1, manifest)
    memory.put("k", 2)
    assert memory.get("k") == 2 and memory.manifest("k") is None and "k" in memory
    cache = provenance.SnapshotCache(spark, f"file://{tmp_path}/cache")
    cache.put("k", spark.range(3), manifest)
    assert "k" in cache and cache.get("k").count() == 3 and cache.manifest("k") == manifest
    cache.put("k", spark.range(2))
    assert cache.get("k").count() == 2 and cache.manifest("k") is None
    old = cache.get("k")
    with pytest.raises(Exception, match="torn"):
        cache.put("k", spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("torn"))).alias("id")), manifest)
    assert "k" in cache and cache.get("k").count() == 2 and cache.manifest("k") is None and len(cache.versions("k")) == 2
    cache.put("k", cache.get("k").where("id = 1"), manifest)
    assert [r.id for r in cache.get("k").collect()] == [1] and cache.manifest("k") == manifest and old.count() == 2
    assert cache.clean("k") == 2 and cache.get("k").count() == 1 and len(cache.versions("k")) == 1
    cache.delete("k")
    assert "k" not in cache and cache.get("k") is None and cache.manifest("k") is None and cache.clean("k") == 0


def test_csv_cells_with_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,symbol,close\n2024-01-01,"A\nB",1\n2024-01-02,"say ""x"", y",2\n , ,\n2024-01-03,plain,3\n')
    (tmp_path / "b.csv").write_text('date;symbol;close\n2024-01-01;"A;""B""";1\n')
    assert readers.has_line_ends_in_cells(spark, str(tmp_path / "a.csv")) and not readers.has_line_ends_in_cells(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in readers.read_rows(spark, str(tmp_path / "a.csv")).collect()] == [("2024-01-01", "A\nB", "1"), ("2024-01-02", 'say "x", y', "2"), ("2024-01-03", "plain", "3")]
    assert [tuple(r) for r in readers.read_rows(spark, str(tmp_path / "b.csv")).collect()] == [("2024-01-01", 'A;"B"', "1")]


def test_bad_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n17\n"text"\n{"a": 2}\n')
    assert [r.a for r in readers.read_rows(spark, str(tmp_path / "a.jsonl")).collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    with pytest.raises(ValueError, match=r"b.jsonl, line 3: not JSON"):
        readers.read_rows(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "c.json").write_text('{"rows": [{"a": 1}, {"a"')
    with pytest.raises(ValueError, match="not JSON"):
        readers.read_rows(spark, str(tmp_path / "c.json"))


def test_scorecard(spark):
    rows = [("a", date(2024, 1, 1) + timedelta(days=i), 100.0 * 1.01**i) for i in range(20)] + [("b", None, 5.0), ("b", None, None)]
    got = {r.entity: r for r in scorecard.scorecard(spark.createDataFrame(rows, "entity string, date date, value double"), Clock(date(2024, 2, 1))).collect()}
    assert got["a"].observations == 20 and got["a"].momentum == pytest.approx(round(50 + (1.01**19 - 1) * 150, 2)) and got["a"].risk_flags == "none flagged" and got["a"].confidence_label == "High"
    assert got["b"].risk_flags == "sparse history; missing as-of date" and got["b"].freshness_days is None


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["annual"]) == 0
    years = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert years and {y["theme"] for y in years} == {"태양광", "반도체", "양자컴퓨팅"} and [(y["year"], y["rank"]) for y in years] == sorted((y["year"], y["rank"]) for y in years)
    (tmp_path / "w.csv").write_text("date,x,y\n2024-01-05,1,2\n2024-01-12,3,4\n")
    assert cli.main(["score", str(tmp_path / "w.csv")]) == 0
    assert {json.loads(x)["entity"] for x in capsys.readouterr().out.splitlines()} == {"x", "y"}
    assert cli.main(["validate", str(tmp_path / "w.csv")]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 4
    assert cli.main(["scorecard", "--table"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("entity | score") and [x.split(" | ")[0] for x in lines[1:]] == ["AI Infrastructure", "Cybersecurity", "Grid Modernization"]


def test_streams(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(day + timedelta(days=i, hours=h), "t", "a", float(i * 10 + h)) for i in range(40) for h in (1, 5)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, theme string, security string, value double")
    df.withColumn("date", F.col("date").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("date timestamp, theme string, security string, value double").parquet(str(tmp_path / "in"))
    weekly_last_stream(stream, "1 days").writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.table("weekly").collect())
    want = sorted((r.week, r.theme, r.security, r.price) for r in panel.last_of_week(panel.normalised(df)).collect())
    assert got == [(w, t, s, p) for w, t, s, p in want]
    late = df.withColumn("feature_available_at", F.col("date") + F.expr("interval 20 hours"))
    assert late_arrivals_stream(late).count() == 40

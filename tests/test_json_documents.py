"""Documents cut into records from any byte offset, against json.loads."""

import json
import random

import pytest

from fathomline.sources import json_documents, readers
from fathomline.sources.json_documents import as_lines
from fathomline.sources.shared import scratch


def records(n, seed=3):
    draw = random.Random(seed)
    odd = ['a "quoted" {word}', "back\\slash", "]},{[", 'ends with \\"', "Ünïcode ☃", "", "line\nend", '"records": [{']
    return [{"i": i, "s": draw.choice(odd) * draw.randint(1, 4), "deep": {"list": [{"x": draw.choice(odd)}] * draw.randint(0, 3), "n": [1, [2, 3]]}} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("shape", ["list", "object", "pretty"])
def test_many_tasks_read_one_document(spark, tmp_path, small_splits, shape):
    want = records(700)
    document = {"name": 'said "rows": 3', "records": want, "count": 700} if shape == "object" else want
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document, ensure_ascii=shape == "list", indent=2 if shape == "pretty" else None), encoding="utf-8")
    target = scratch(spark)
    assert as_lines(spark, str(path), readers.LIST_FIELDS, target)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10
    got = sorted((json.loads(r.value) for r in spark.read.text(target).collect()), key=lambda r: r["i"])
    assert got == want
    rows = readers.read_rows(spark, str(path), split_above=0)
    assert sorted(r.s for r in rows.collect()) == sorted(r["s"] for r in want)


def test_other_documents_are_left_to_the_whole_reader(spark, tmp_path):
    own = records(5)
    others = [[], {}, own[0], [1, *own], {"meta": {"a": 1}, "rows": own}, {"other": own}, {"rows": own, "data": [{"i": 1}]}, [own], {"rows": [[1], *own]}, [*own, "x{"], {"rows": {"a": own}}]
    for i, document in enumerate(others):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(document))
        assert not as_lines(spark, str(path), readers.LIST_FIELDS, scratch(spark)), document
    for i, text in enumerate(['{"rows": [{"a": 1}]}', '{"rows": [{"a": 1}], "n": 2}\n', '\ufeff[{"a": 1}]\n', '\ufeff{"n": 1, "rows": [{"a": 1}]}', ' [ {"a": 1} ]']):
        (tmp_path / f"own{i}.json").write_text(text, encoding="utf-8")
        target = scratch(spark)
        assert as_lines(spark, str(tmp_path / f"own{i}.json"), readers.LIST_FIELDS, target) and [r.value for r in spark.read.text(target).collect()] == ['{"a": 1}'], text
    plain, cut = (readers.read_rows(spark, str(tmp_path / "4.json"), split_above=x) for x in (1 << 40, 0))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_text_after_the_end_is_not_cut(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1}]}')
    assert not as_lines(spark, str(tmp_path / "d.json"), readers.LIST_FIELDS, scratch(spark))


def test_a_torn_document_raises(spark, tmp_path):
    for i, text in enumerate(['[{"a": 1}, {"a": 2', '{"rows": [{"a": 1}]', '{"rows": [{"a": 1}', '[{"a": 1}, {"a": x}]', '{"rows": [{"a": 1}, {"a" 2}]}']):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises(ValueError, match=f"{i}.json: not JSON"):
            readers.read_rows(spark, str(path), split_above=0)


def test_no_group_grows_with_a_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_documents, "BLOCK", 5)
    want = records(700)
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"rows": want}), encoding="utf-8")
    pieces = json_documents._pieces(spark, str(path))
    assert max(r["count"] for r in pieces.groupBy("file", "block").count().collect()) <= 32
    target = scratch(spark)
    assert as_lines(spark, str(path), readers.LIST_FIELDS, target)
    assert sorted((json.loads(r.value) for r in spark.read.text(target).collect()), key=lambda r: r["i"]) == want

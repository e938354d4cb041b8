"""The pipeline's stages and its whole run."""

import re
from collections import defaultdict

import corpus_pipeline
from test_decontaminate import brute
from test_dedup import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    planted = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, docs.first()["text"], "en", "s", 1)], docs.schema)
    docs = docs.union(planted)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            want = {d for d, t in before if t and re.search(r"[^\W\d_]", t)}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for d, t in before:
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
            want = {min(g) for g in groups.values()}
        elif name == "near_dedup":
            want = {d for d, (_, c) in brute_components(before, 5, 80).items() if d == c}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {r[0] for r in brute(before, items, 10) if not r[-1]}
        assert kept == want, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_stages_decide_by_row(spark):
    """Repeated and null ids, repeated rows, and columns whose names the operators use themselves."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    base = " ".join(words)
    near = " ".join(words[:-1] + ["end"])
    item = " ".join(f"item{i}" for i in range(12))
    other = lambda i: " ".join(f"o{i}x{j}" for j in range(15))
    rows = [
        (5, f"leak {item} leak"), (5, other(1)), (None, f"{item} too"), (7, other(2)), (None, other(3)), (None, other(3)), (3, base), (5, base + " "), (5, near), (6, other(4)), (6, near), (None, near), (8, None), (8, ""), (None, "123"),
        (9, "x" * 100_000), (9, "short"), (9, "short"),
    ]
    clash = ["score", "lang_pred", "_text", "component_id", "_0", "n_words", "spans", "items", "_row", "letters", "text_", "bands", "_hash", "h"]
    docs = spark.createDataFrame([(d, t, "en", *(f"{i}{c}" for c in clash)) for i, (d, t) in enumerate(rows)], f"doc_id bigint, text string, lang string, {', '.join(f'`{c}` string' for c in clash)}")
    place = lambda df: sorted(int(r.score.removesuffix("score")) for r in df.collect())
    want = {"language_id": [i for i, (_, t) in enumerate(rows) if t and re.search(r"[^\W\d_]", t)]}
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i))
    stage = dict(corpus_pipeline.STAGES)
    assert place(stage["language_id"](spark, docs, SF)) == want["language_id"]
    got = place(stage["exact_dedup"](spark, docs, SF))
    assert len(got) == len(groups) and all(any(min(g)[:2] == x[:2] and x[2] in got for x in g) for g in groups.values())
    near_of = brute_components([(i, t) for i, (_, t) in enumerate(rows)], 5, 80)
    members = defaultdict(list)
    for i, (_, c) in near_of.items():
        members[c].append((rows[i][0] is None, rows[i][0] or 0, i))
    assert max(map(len, members.values())) == 5
    got = stage["near_dedup"](spark, docs, SF)
    assert place(got) == sorted(min(m)[2] for m in members.values()) and got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    bench = spark.createDataFrame([("q", item), (None, "no such words at all")], "item_id string, text string")
    for phrase_bytes in (1 << 20, 200):
        got = corpus_pipeline.decontaminate.drop_contaminated(docs, bench, phrase_bytes=phrase_bytes)
        assert place(got) == [i for i, (_, t) in enumerate(rows) if item not in (t or "")] and got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    pieces = stage["packing"](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []

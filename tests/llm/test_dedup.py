"""Exact and near duplicates against brute force."""

import random
import re
import time
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import exact_dup, near_dup, queries
from fathomline.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, _hash string, component_id bigint, band string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(docs, k, percent):
    sets = {}
    for doc_id, text in docs:
        w = words_of(text)
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for o in holders[x]:
                if o > d:
                    common[o] += 1
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                up[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def fixture_docs(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((n, rng.choice([" ", "\n", "  "]).join(w)))
            n += 1
    base = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(60):  # near copies of each other, many just below the threshold
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((n, " ".join(w)))
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "One two"), (n + 6, "é " * 30000), (n + 7, "É " * 3)]
    return docs


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    docs = fixture_docs()
    df = spark.createDataFrame([(a, b, "x", 7, "y") for a, b in docs], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, k, 80).collect()}
    assert got == brute_components(docs, k, 80)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    docs = fixture_docs(9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 2, 80).collect()}
    assert got == brute_components(docs, 2, 80)


def test_near_duplicates_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op8_fast_sketch_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(docs, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dup.near_duplicates(empty, 2).collect() == []
    rows = near_dup.near_duplicates(spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (5, "a b c"), (6, None), (7, "")], "doc_id bigint, text string"), 2).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, None, True), (5, 3, False), (6, 6, True), (7, 7, True)], key=str)


def test_near_copies_that_share_an_id(spark):
    """300 near copies under one id, others linked to them through other ids of theirs: as fast as rows of 300 ids, and right by brute force over rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]

    def copies(n, base):
        for _ in range(n):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(words)
            yield " ".join(own)

    one, two, three = (rng.sample(words, 120) for _ in range(3))
    rows = [(77, t) for t in copies(300, one)] + [(i, t) for i, t in enumerate(copies(20, two), 100)] + [(110, " ".join(three)), (200, " ".join(three)), (201, " ".join(three)), (77, " ".join(two)), (300, " ".join(rng.sample(words, 50))), (301, None), (77, None)]
    ids = spark.createDataFrame([(1000 + i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    near_dup.near_duplicates(ids, 2, 80).collect()  # warm
    started = time.time()
    near_dup.near_duplicates(ids, 2, 80).collect()
    apart = time.time() - started
    started = time.time()
    got = near_dup.near_duplicates(df, 2, 80).collect()
    assert time.time() - started < 3 * apart + 5
    by_row = brute_components([(i, t) for i, (_, t) in enumerate(rows)], 2, 80)
    nodes = {i: i for i, _ in rows}

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for i, (doc_id, _) in enumerate(rows):
        x, y = find(doc_id), find(rows[by_row[i][1]][0])
        nodes[max(x, y)] = min(x, y)
    want = sorted((d, by_row[i][0], find(d)) for i, (d, t) in enumerate(rows) if t)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles) == want
    assert find(77) == find(200) == 77 and len(got) == len(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (103, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("reach", [1, 4])
def test_components_of_long_chains(spark, reach):
    ids = list(range(3000))
    random.Random(reach).shuffle(ids)
    links = [(ids[i], ids[i + d]) for i in range(3000) for d in range(1, reach + 1) if i + d < 3000 and i // 2500 == (i + d) // 2500]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: min(part) for part in (ids[:2500], ids[2500:]) for x in part}


def test_exact_duplicates(spark):
    docs = [(9, "a  b", 1), (2, "a\tb", 1), (5, "a b", 2), (2, "a\nb", 3), (7, None, 1), (8, "", 1), (4, "c", 1), (None, "c", 1), (None, "d", 1), (11, "x" * 3_000_000, 0), (12, "x" * 3_000_000, 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, _hash int")
    rows = exact_dup.exact_duplicates(df).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str)
    want = [(9, 2, 4, False), (2, 2, 4, True), (5, 2, 4, False), (2, 2, 4, False), (7, 7, 2, True), (8, 7, 2, False), (4, 4, 2, True), (None, 4, 2, False), (None, None, 1, True), (11, 11, 2, True), (12, 11, 2, False)]
    assert got == sorted(want, key=str)
    stay = exact_dup.drop_exact_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stay.collect()) == [(False, 2), (False, 4), (False, 7), (False, 11), (True, 0)]
    assert exact_dup.exact_duplicates(df.limit(0)).collect() == [] and exact_dup.drop_exact_duplicates(df.limit(0)).collect() == []


def test_grace_partitions_recursively(monkeypatch):
    monkeypatch.setattr(exact_dup, "BUDGET", 20_000)
    rng = random.Random(2)
    texts = [f"text {rng.randint(0, 900)} " + "x" * rng.randint(0, 1) * 50 for _ in range(20_000)]
    hashes = [hash(t) // 50 * 50 for t in texts]  # many collisions, settled by the texts
    kinds = [("_hash", pa.int64()), ("_norm", pa.string()), ("_id", pa.int64()), ("_copies", pa.int64())]
    schema = pa.schema([pa.field(n, k, False) for n, k in kinds] + [pa.field("_0", pa.string())])
    table = pa.table([pa.array(hashes, pa.int64()), texts, pa.array(range(20_000), pa.int64()), pa.array([1] * 20_000, pa.int64()), [str(i) for i in range(20_000)]], schema=schema)
    out = [b for t in exact_dup._grace(exact_dup._chunks(table.to_batches(max_chunksize=700))) for b in t.to_batches()]
    assert len(out) > 1 and all(b.schema == schema for b in out)
    want = {}
    for i, t in enumerate(texts):
        want[t] = (want[t][0], want[t][1] + 1, want[t][2]) if t in want else (i, 1, str(i))
    assert {r["_norm"]: (r["_id"], r["_copies"], r["_0"]) for b in out for r in b.to_pylist()} == want


def test_exact_duplicates_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = {d: (min(g), len(g), d == min(g)) for g in groups.values() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in queries.op7_grace_hash_dedup(spark, SF).collect()} == want
    assert docs.select(F.count("*")).first()[0] == len(want)

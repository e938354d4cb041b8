"""Decontamination by FM-index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from fathomline.llm import decontaminate as D
from fathomline.llm import queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, length):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + length]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("phrase_bytes", [1 << 20, 1500])
def test_matches_brute_force(spark, phrase_bytes):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "é", "7x", "dd", "Eé"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(12)] + [(100, None), (None, "a b c d"), (7, "c c c c")]
    docs = [(i, text(rng.choice([0, 1, 4, 30, 200]))) for i in range(60)] + [(500, None), (501, ""), (None, "a B c d"), (502, "a b c d " * 5000), (502, "a b c d " * 5000)]
    found = D.contamination(spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id bigint, text string, items string, spans string"), spark.createDataFrame(items, "item_id bigint, text string"), length=4, phrase_bytes=phrase_bytes)
    assert rows_of(found) == brute(docs, items, 4)


def test_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(queries.op10_fm_index_decontamination(spark, SF))
    assert got == brute(docs, items, 10) and any(r[-1] for r in got)


def test_blocks_are_bounded(spark):
    """One hot id, null ids and an item longer than a block: no block is larger than phrase_bytes, and each window lies in one."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    items = [(1, text(12)) for _ in range(300)] + [(None, text(9)) for _ in range(200)] + [(2, text(3000))]
    table = spark.createDataFrame(items, "item_id string, text string")
    blocks = list(D._blocks(table, 8000, 5))
    assert len(blocks) > 5 and [last for last, _ in blocks] == [False] * (len(blocks) - 1) + [True]
    assert all(sum(len(t) + len(i or "") + 64 for i, t in own) <= 8000 for _, own in blocks)
    windows = lambda rows: {("" if i is None else str(i), *w[k : k + 5]) for i, t in rows for w in [words_of(t)] for k in range(max(1, len(w) - 4))}
    assert windows([x for _, own in blocks for x in own]) == windows(items)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(D.contamination(docs, none)) == brute([(1, "a b")], [], 10)
    assert D.contamination(docs.limit(0), none).collect() == []


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    parts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(50)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = D.FMIndex(text, 5)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 6, (30, n))
        padded = np.concatenate([np.zeros((30, 5 - n), np.int64), phrases], 1)
        low, high = index.search(padded)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - n) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want

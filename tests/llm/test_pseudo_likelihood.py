"""Masked pseudo-likelihood against a plain implementation, and that it learns."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import pseudo_likelihood as P
from fathomline.llm import queries

SF = "/root/testdata/sf0.1"


def plain(text, top, flat):
    """Sum of log p over words, one by one, from the definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    m = {k: v.astype(np.float64) for k, v in P.views(flat).items()}
    ids = [int(P.tokens_of(hashed(w), top)[0]) for w in words]
    total = 0.0
    for i, t in enumerate(ids):
        around = [ids[i + d] if 0 <= i + d < len(ids) else 0 for d in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([m["e"][a] for a in around]) @ m["w"] + m["b"])
        group, place = divmod(t, P.PLACES)
        one, two = h @ m["g"] + m["gb"], (h + m["u"][group]) @ m["p"] + m["pb"][group]
        total += one[group] - np.log(np.exp(one).sum()) + two[place] - np.log(np.exp(two).sum())
    return len(words), total


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return P.word_keys(data, np.array([0]), np.array([len(data)]))


TEXTS = ["The cat sat on the mat .", "the", None, "", " \n", "THE cat é\tsat", "a b " * 3000, "the", "x" * 100_000]


def test_scores_match_the_definition(spark):
    docs = spark.createDataFrame([(i if i != 7 else None, t, 1) for i, t in enumerate(TEXTS)] + [(1, "the", 1)], "doc_id bigint, text string, n_words int")
    top, flat = P.fit(docs)
    rows = P.scores(docs, (top, flat)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        n, want = plain(TEXTS[7 if r.doc_id is None else r.doc_id], top, flat)
        assert r.n_words == n and np.isclose(r.log_likelihood, want, rtol=1e-3, atol=1e-3)
        assert (r.mean_log_likelihood is None) == (n == 0)


def test_it_learns_from_both_sides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    per_word = lambda df, m: P.scores(df, m).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    counts_only, trained = P.fit(docs, rounds=0), P.fit(docs)
    assert per_word(docs, trained) > per_word(docs, counts_only) + 0.5
    mixed = docs.withColumn("text", F.array_join(F.shuffle(F.split("text", " "), 7), " "))
    assert per_word(docs, trained) > per_word(mixed, trained)


def plain_fit(flat, around, target):
    """The training from its definition: softmaxes apart, sums over tokens one by one."""
    m, seen = {k: v.astype(np.float64) for k, v in P.views(flat).items()}, {k: np.full(v.shape, 0.01) for k, v in P.views(flat).items()}
    for at in range(0, len(target), P.BATCH):
        grads = {k: np.zeros_like(v) for k, v in m.items()}
        a, t = around[at : at + P.BATCH], target[at : at + P.BATCH]
        for left_right, token in zip(a, t, strict=True):
            x = np.concatenate([m["e"][i] for i in left_right])
            h = np.tanh(x @ m["w"] + m["b"])
            group, place = divmod(int(token), P.PLACES)
            one, two = np.exp(h @ m["g"] + m["gb"]), np.exp((h + m["u"][group]) @ m["p"] + m["pb"][group])
            one, two = one / one.sum(), two / two.sum()
            one[group] -= 1
            two[place] -= 1
            grads["g"] += np.outer(h, one)
            grads["gb"] += one
            grads["p"] += np.outer(h + m["u"][group], two)
            grads["pb"][group] += two
            grads["u"][group] += m["p"] @ two
            back = (m["g"] @ one + m["p"] @ two) * (1 - h * h)
            grads["w"] += np.outer(x, back)
            grads["b"] += back
            for i, d in zip(left_right, (m["w"] @ back).reshape(-1, P.WIDTH), strict=True):
                grads["e"][i] += d
        for k, g in grads.items():
            g /= len(t)
            seen[k] += g * g
            m[k] -= P.RATE * g / np.sqrt(seen[k])
    return m


def test_training_matches_the_definition(monkeypatch):
    monkeypatch.setattr(P, "BATCH", 20)
    rng = np.random.default_rng(4)
    flat = P.start(rng.integers(0, 50, P.VOCABULARY))
    around, target = rng.integers(0, P.VOCABULARY, (50, 4)), rng.integers(0, P.VOCABULARY, 50)
    want, got = plain_fit(flat.copy(), around, target), flat.copy()
    P.train(got, around, target, np.full(P.SIZE, 0.01, np.float32))
    for name, weights in P.views(got).items():
        assert np.allclose(weights, want[name], atol=2e-3), name


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    flat = P.start(rng.integers(0, 50, P.VOCABULARY))
    around, target = rng.integers(0, P.VOCABULARY, (64, 4)), rng.integers(0, P.VOCABULARY, 64)
    before = P.Model(flat)(around, target).mean()
    for _ in range(5):
        P.train(flat, around, target, np.full(P.SIZE, 0.01, np.float32))
    assert P.Model(flat)(around, target).mean() > before + 0.1


def test_contexts_end_with_texts():
    assert P.contexts(np.array([1, 2, 3, 4]), np.array([1, 0, 3])).tolist() == [[0, 0, 0, 0], [0, 0, 3, 4], [0, 2, 4, 0], [2, 3, 0, 0]]


def test_every_window_trains_once(spark):
    texts = ["a b c", "d", None, "e f", "", "g h i j k l m"] * 40 + [f"n{i} o" for i in range(90)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    at = spark.sparkContext.broadcast
    top, flat = at(np.zeros(0, np.uint64)), at(P.start(np.ones(P.VOCABULARY)))
    used = [P.of_round(docs.fillna(""), turn, 3).mapInArrow(P._trained(top, flat), P.PARTS).where("block = 0").agg(F.sum("windows")).first()[0] for turn in range(3)]
    assert sum(used) == 13 * 40 + 180 and min(used) > 0


@pytest.mark.parametrize("listed", [1 << 18, 40, 0])
def test_scores_are_of_words_not_of_shared_tokens(spark, monkeypatch, listed):
    monkeypatch.setattr(P, "LISTED", listed)
    common = " ".join(f"w{i}" for i in range(P.OWN - 1) for _ in range(9))
    texts = [common] + [f"w1 r{i % 60} w2 r{i % 7}" for i in range(240)] + ["w1 once w2", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts, (top, flat) = P.word_counts(docs), P.fit(docs)
    n = Counter(" ".join(t or "" for t in texts).split())
    token = {w: int(P.tokens_of(hashed(w), top)[0]) for w in [*n, "never"]}
    shared = Counter()
    for w, times in n.items():
        shared[token[w]] += times
    inner = lambda t: sum(math.log(max(n[w], 1) / (shared[token[w]] + 1)) for w in (t or "").split() if token[w] >= P.OWN)
    for r in P.scores(docs, (top, flat), counts=counts).collect():
        words, of_tokens = plain(texts[r.doc_id], top, flat)
        assert r.n_words == words and np.isclose(r.log_likelihood, of_tokens + inner(texts[r.doc_id]), rtol=1e-3, atol=1e-3)
    new = spark.createDataFrame([(0, "w1 never w2")], "doc_id bigint, text string")
    assert np.isclose(P.scores(new, (top, flat), counts=counts).first().log_likelihood, plain("w1 never w2", top, flat)[1] + inner("w1 never w2"), rtol=1e-3)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.scores(none, P.fit(none)).collect() == []


def test_query_covers_every_document(spark):
    rows = queries.op6_masked_pseudo_likelihood(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.log_likelihood <= 0 for r in rows)
    assert {r.doc_id: r.n_words for r in rows} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs.items()}

"""Kneser-Ney models against a plain definition, passages against all windows, held-out accuracy and edge cases."""

from collections import defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import toxicity as T
from fathomline.llm.queries import op11_kneser_ney_toxicity

SF = "/root/testdata/sf0.01"


def plain(text: str) -> bytes:
    return bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b < 91 else b for b in text.encode())


def windows(texts):
    """Each byte with the ORDER - 1 before it, in reading order."""
    for t in texts:
        whole = b" " * (T.ORDER - 1) + plain(t)
        for i in range(len(whole) - T.ORDER + 1):
            yield whole[i : i + T.ORDER]


def brute(classes):
    """P(last byte | before) of each class as a function of an n-gram, by the definition of interpolated Kneser-Ney."""
    sets = [set(windows(c)) for c in classes]
    models = []
    for c, own in zip(classes, sets, strict=True):
        levels = []
        for n in range(1, T.ORDER + 1):
            count = defaultdict(int)
            if n == T.ORDER:
                for w in windows(c):
                    count[w] += 1
            else:
                for longer in {w[-n - 1 :] for w in (sets[0] | sets[1] if n <= T.SHARED else own)}:
                    count[longer[1:]] += 1
            ones, twos = sum(v == 1 for v in count.values()), sum(v == 2 for v in count.values())
            levels.append((count, ones / (ones + 2 * twos) if ones and twos else 0.5))

        def p(gram, levels=levels):
            if not gram:
                return 1 / 256
            count, d = levels[len(gram) - 1]
            after = [v for g, v in count.items() if g[:-1] == gram[:-1]]
            if not after:
                return p(gram[1:], levels)
            return max(count.get(gram, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:], levels)

        models.append(p)
    return models


ORDINARY = ["The cat sat on the mat.", "A dog\tand a cat", "über das Land und über"]
TOXIC = ["you fool, you FOOL", "the fool sat"]


def test_models_are_interpolated_kneser_ney():
    counted = []
    for texts in (ORDINARY, TOXIC):
        keys, _ = T.grams(pa.array(texts))
        counted.append(np.unique(keys, return_counts=True))
    models, plainly = T.kneser_ney(counted), brute([ORDINARY, TOXIC])
    texts = ["the fool and the cat", "xyzzy über", "FOOL"]
    found, offsets = T.evidence(models, pa.array(texts))
    want = [log(plainly[1](w)) - log(plainly[0](w)) for w in windows(texts)]
    assert np.allclose(found, want, atol=1e-12)
    assert offsets.tolist() == np.cumsum([0, *[len(t.encode()) for t in texts]]).tolist()


def test_each_class_sums_to_one():
    counted = [np.unique(T.grams(pa.array(c))[0], return_counts=True) for c in (ORDINARY, TOXIC)]
    for levels in T.kneser_ney(counted):
        for before in (b"the ", b" a d", b"zzzz"):
            keys = np.array([int.from_bytes(bytes([b]) + before[::-1], "big") for b in range(256)], np.uint64)
            assert abs(np.exp(T.log_likelihood(levels, keys)).sum() - 1) < 1e-9


def test_passages_are_the_best_windows():
    counted = [np.unique(T.grams(pa.array(c))[0], return_counts=True) for c in (ORDINARY, TOXIC)]
    models = T.kneser_ney(counted)
    texts = ["the cat sat " * 30 + "you fool " + "on the mat " * 20, "fool", "", "x"]
    found = T.measures(models, pa.array(texts))
    for i, text in enumerate(texts):
        ratio, _ = T.evidence(models, pa.array([text]))
        assert found[i, 0] == pytest.approx(ratio.mean() if len(ratio) else 0.0, abs=1e-12)
        for j, length in enumerate(T.PASSAGES, 1):
            best = max((ratio[k : k + length].sum() for k in range(max(len(ratio) - length, 0) + 1)), default=0.0)
            assert found[i, j] == pytest.approx(best / length, abs=1e-9)


def test_held_out_texts(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op11_kneser_ney_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you are a fool", 5), (2, "a fine day", 6), (2, "a fine day", 6), (None, None, 7), (3, "", 8), (4, "fool " * 300_000, 9)], "doc_id bigint, text string, score int")
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id bigint, toxic int")
    model = T.fit(docs, marks)
    found = T.toxicity(docs, model, keep=("doc_id", "score"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 6 and sorted(r[1] for r in rows) == [5, 6, 6, 7, 8, 9]
    by = {r[1]: r[2] for r in rows}
    assert by[7] == by[8] and by[5] > by[6]
    none = T.fit(docs, marks.limit(0))
    assert {r.score for r in T.toxicity(docs, none).collect()} == {0.5}
    assert T.toxicity(docs.limit(0), model).count() == 0
    only = T.fit(docs, marks.where("toxic = 0"))
    assert all(r.score < 0.5 for r in T.toxicity(docs, only).collect())

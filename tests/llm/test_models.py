"""Language ID and quality: held-out accuracy and edge cases."""

import math
import re

import numpy as np

from fathomline.llm import language, quality, queries
from fathomline.llm import words as W

SF = "/root/testdata/sf0.01"


def auc(score, good):
    order = np.argsort(np.argsort(score)) + 1
    n = good.sum()
    return (order[good].sum() - n * (n + 1) / 2) / (n * (~good).sum())


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op5_byte_cnn_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == docs.count() and len(held) > 250
    assert (held.lang_pred == held.lang).mean() > 0.97 and rows.score.between(0, 1).all()


def test_language_edges(spark):
    train = [(i, t * 40, lang) for i in range(60) for t, lang in (("the house and the dog ", "en"), ("das haus und der hund ", "de"))] + [(1000, "x", None), (1001, None, "en")]
    labelled = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    asks = [(1, "the dog and the house " * 50_000), (2, None), (3, ""), (4, "123 ... !"), (5, "d"), (None, "der hund und das haus"), (5, "d"), (6, "der hund " * 100)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in asks], "doc_id bigint, text string, score int, lang_pred string")
    got = language.languages(df, labelled).collect()
    assert len(got) == len(asks)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1][0] == "en" and by[6][0] == "de" and by[None][0] == "de"
    assert by[2] == by[3] == by[4] == ("und", 0.0) and by[5][0] in ("en", "de")
    assert {r.lang_pred for r in language.languages(df, labelled.limit(0)).collect()} == {"und"}
    assert language.languages(df.limit(0), labelled).collect() == []


def plain_language(text, model, names):
    """A text's probabilities from the definition: windows of bytes, one by one, weighted by their bytes."""
    data = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    total = np.zeros(len(names))
    for at in range(0, len(data), language.WINDOW):
        own = data[at : at + language.WINDOW]
        x = list(own) + [0] * (language.WINDOW - len(own))
        h = []
        for f in model["filters"]:
            places = [sum(f[j][x[i + j]].astype(np.float64) for j in range(len(f))) for i in range(len(x) - len(f) + 1)]
            h += np.maximum(np.max(places, 0), 0).tolist()
        z = np.exp(np.array(h) @ model["out"] + model["bias"])
        total += z / z.sum() * len(own)
    return total / len(data)


def test_language_matches_its_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = docs.where(queries.remainder(3) != 1)
    names, model = language.fit(learn, "text", "lang")
    texts = [r.text for r in docs.where("text rlike '[a-z]'").orderBy("doc_id").limit(6).collect()] + ["é" * 700, "A", "x" * 512, "y" * 513, "Das Haus. " * 120]
    asks = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in language.languages(asks, learn).collect():
        want = plain_language(texts[r.doc_id], model, names)
        assert np.isclose(r.score, want.max(), atol=1e-3) and (r.lang_pred == names[int(want.argmax())] or np.sort(want)[-1] - np.sort(want)[-2] < 2e-3)


def test_language_sample_is_bounded(spark, monkeypatch):
    """Copies of a text count once: they neither reach the driver nor crowd out others."""
    taken = []
    monkeypatch.setattr(language, "train", lambda x, y, n, **_: taken.append((x, y)) or {})
    rows = [("same text", "en")] * 4000 + [(f"other text {i}", "en") for i in range(300)] + [(f"ein text {i}", "de") for i in range(5)] + [(f"neu {i}", "de") for i in range(900)]
    language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), "text", "lang", per_language=200)
    (x, y), = taken
    assert len({w.tobytes() for w in x}) == len(x) and 140 < (y == 1).sum() < 260 and 140 < (y == 0).sum() < 260


def test_language_trains_alike_twice(spark):
    a, b = (sorted(queries.op5_byte_cnn_language(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert a == b


def test_tables_give_the_networks_responses():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    filters = [rng.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS]
    out, bias = rng.normal(size=(3 * language.FILTERS, 4)).astype(np.float32), np.zeros(4, np.float32)
    h = np.maximum(np.concatenate([r.max(1) for r in language._responses(x, filters)], 1), 0)
    z = h @ out
    want = np.exp(z - z.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose(language.Scorer({"filters": filters, "out": out, "bias": bias})(x), want, atol=1e-4)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op9_factorisation_machine_quality(spark, SF).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert auc(held.score.to_numpy(), (held.quality == 1).to_numpy()) > 0.95
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9 and (rows.predicted == (rows.score >= 0.3)).all()


def test_quality_edges(spark):
    docs = [(1, "good words here", 15), (2, None, None), (3, "", 0), (None, "x " * 400_000, 3), (4, "AA!! BB!!", 9), (4, "AA!! BB!!", 9)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id bigint, text string, n_chars bigint, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(df, none)
    rows = quality.quality(df, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    model = quality.fit(df, spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int"))
    by = {r.doc_id: r.score for r in quality.quality(df, model).collect()}
    assert by[1] > by[4]
    assert quality.quality(df.limit(0), model).collect() == []


def plain_features(text, chars):
    """Feature number -> value, from the definition."""
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.lower())  # bytes.lower() changes A-Z only
    hashes = {int(W.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words}
    own = {h % quality.WORDS for h in hashes}
    out = {i: 1 / math.sqrt(max(len(own), 1)) for i in own}
    log = lambda v: math.log2(max(v, 0) + 1)
    share = lambda test: sum(map(test, data)) / max(len(data), 1)
    n, top = len(words), quality.LEVELS - 1
    marks = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    levels = [
        log(n), log(len(data) - n) / max(log(n), 1) * 4, len(hashes) / max(n, 1) * top, share(lambda b: 65 <= b < 91) * top * 2, math.sqrt(share(lambda b: 48 <= b < 58)) * top, math.sqrt(share(marks)) * top,
        math.sqrt(share(lambda b: b == 10)) * top * 2, share(lambda b: b >= 128) * top * 2, len(data) / max(n, 1), 0 if chars < 0 else log(chars) * 0.75 + 1,
    ]
    for i, level in enumerate(levels):
        out[quality.WORDS + i * quality.LEVELS + int(min(max(level, 0), top))] = 1 / math.sqrt(len(levels))
    return out


def test_quality_matches_its_definition(spark):
    """The whole way from a text to its score, features and pairs one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where(queries.remainder(5) != 0))
    rows = [(r.doc_id, r.text, r.n_chars) for r in docs.orderBy("doc_id").limit(25).collect()] + [(10**6, None, None), (10**6 + 1, "", 0), (10**6 + 2, "ONE two TWO\n\n3,4 é", 18), (10**6 + 3, "a b " * 40_000, 5)]
    for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), model).collect():
        _, text, chars = next(x for x in rows if x[0] == r.doc_id)
        x = plain_features(text or "", -1 if chars is None else chars)
        z = model["b"] + sum(model["w"][i] * v for i, v in x.items())
        items = list(x.items())
        vectors = [model["v"][i].astype(np.float64) * v for i, v in items[:150]]
        if len(items) <= 150:
            z += sum(vectors[a] @ vectors[b] for a in range(len(vectors)) for b in range(a))
        else:
            every = np.array([model["v"][i].astype(np.float64) * v for i, v in items])
            z += np.triu(every @ every.T, 1).sum()
        assert np.isclose(r.score, 1 / (1 + math.exp(-z)), atol=1e-3)


def test_quality_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "train", lambda number, value, count, y, **_: taken.append(y) or {})
    docs = spark.createDataFrame([(1, f"copy {i}", 1) for i in range(3000)] + [(i, f"text {i}", 1) for i in range(2, 60)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(1, i % 2) for i in range(500)] + [(i, 1) for i in range(2, 60)], "doc_id bigint, quality int")
    quality.fit(docs, labels, sample=100)
    assert sorted(taken[0].tolist()) == [0.0] + [1.0] * 58


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(2)
    model = {"b": 0.3, "w": rng.normal(size=quality.SIZE), "v": rng.normal(size=(quality.SIZE, quality.RANK))}
    number, value = rng.choice(quality.SIZE, 7, replace=False), rng.random(7)
    want = 0.3 + sum(model["w"][i] * x for i, x in zip(number, value, strict=True))
    want += sum(model["v"][number[a]] @ model["v"][number[b]] * value[a] * value[b] for a in range(7) for b in range(a))
    assert np.isclose(quality.raw_scores(model, number, value, np.array([7]))[0][0], want)

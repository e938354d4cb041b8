"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2)): all pairs of features interact through vectors of low rank, in
time linear in a text's features. Words are hashed; counts and shares (length, letters in upper case, digits, marks, lines, repeats) are cut into levels, one
feature each, as is the metadata (the table's own n_chars, where there is one).
Trained in numpy on the driver by Adagrad, with the features of a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.shared import released, set_up

WORDS = 1 << 15
LEVELS = 16
STATISTICS = 10
SIZE = WORDS + STATISTICS * LEVELS
RANK = 8
SAMPLE = 6000
LEAST = 0.3


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.int64)


CLASSES = [_table(lambda b: 65 <= b < 91), _table(lambda b: 48 <= b < 58), _table(lambda b: 33 <= b < 127 and not chr(b).isalnum()), _table(lambda b: b == 10), _table(lambda b: b >= 128)]


def features(texts: pa.Array, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, their values, features of each text), text by text. chars: the metadata, below 0 where unknown."""
    data, offsets = W.bytes_of(texts)
    n_texts, size = len(texts), np.diff(offsets)
    start, end, n = W.spans(data, offsets, W.SPACED)
    hashes = W.word_hashes(data, start, end)
    kinds, n_kinds = W.distinct(hashes, n)
    text = np.repeat(np.arange(n_texts), n_kinds)
    code = np.unique(text * WORDS + (kinds & np.uint64(WORDS - 1)).astype(np.int64))
    text, word = code // WORDS, code % WORDS
    n_words = np.bincount(text, minlength=n_texts)
    value = 1 / np.sqrt(np.maximum(n_words, 1))[text]
    shares = []
    for table in CLASSES:
        total = np.concatenate([[0], np.cumsum(table[data])])
        shares.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
    log = lambda v: np.log2(np.maximum(v, 0) + 1)
    levels = [
        log(n),
        log(size - n) / np.maximum(log(n), 1) * 4,
        n_kinds / np.maximum(n, 1) * (LEVELS - 1),
        shares[0] * (LEVELS - 1) * 2,
        np.sqrt(shares[1]) * (LEVELS - 1),
        np.sqrt(shares[2]) * (LEVELS - 1),
        np.sqrt(shares[3]) * (LEVELS - 1) * 2,
        shares[4] * (LEVELS - 1) * 2,
        size / np.maximum(n, 1),
        np.where(chars < 0, 0, log(chars) * 0.75 + 1),
    ]
    level = np.clip(np.stack(levels, 1), 0, LEVELS - 1).astype(np.int64) + WORDS + np.arange(STATISTICS) * LEVELS
    all_text = np.concatenate([text, np.repeat(np.arange(n_texts), STATISTICS)])
    order = np.argsort(all_text, kind="stable")
    number = np.concatenate([word, level.ravel()])[order]
    return number, np.concatenate([value, np.full(level.size, 1 / np.sqrt(STATISTICS))])[order].astype(np.float32), n_words + STATISTICS


def raw_scores(model: dict, number: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores before the sigmoid, sums of v x for each text and rank). Every text has features."""
    at = np.concatenate([[0], np.cumsum(count)[:-1]])
    vx = model["v"][number] * value[:, None]
    total = np.add.reduceat(vx, at)
    pairs = 0.5 * (total**2 - np.add.reduceat(vx * vx, at)).sum(1)
    return model["b"] + np.add.reduceat(model["w"][number] * value, at) + pairs, total


def train(number: np.ndarray, value: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 12, least_steps: int = 500, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    model = {"b": 0.0, "w": np.zeros(SIZE, np.float32), "v": rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)}
    if not len(y):
        return model
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)  # both classes count alike, whatever their shares
    seen_w, seen_v = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, RANK), 1e-2, np.float32)
    begin = np.concatenate([[0], np.cumsum(count)])
    for _ in range(max(epochs, -(-least_steps * batch // len(y)))):  # a small sample is gone through more often
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            n = count[rows]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rows], n)
            i, x, text = number[place], value[place], np.repeat(np.arange(len(rows)), n)
            z, total = raw_scores(model, i, x, n)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32) * weight[rows] / len(rows) * 16
            model["b"] -= 0.02 * float(d.mean())
            gw = d[text] * x
            gv = gw[:, None] * (total[text] - model["v"][i] * x[:, None])
            own, where = np.unique(i, return_inverse=True)
            sum_w, sum_v = np.bincount(where, gw, len(own)).astype(np.float32), np.zeros((len(own), RANK), np.float32)
            np.add.at(sum_v, where, gv)
            sum_w += decay * model["w"][own]
            sum_v += decay * model["v"][own]
            seen_w[own] += sum_w**2
            seen_v[own] += sum_v**2
            model["w"][own] -= rate * sum_w / np.sqrt(seen_w[own])
            model["v"][own] -= rate * 0.5 * sum_v / np.sqrt(seen_v[own])
    return model


def _featured(batches):
    for batch in batches:
        chars = batch.column(1).to_numpy(zero_copy_only=False)
        for at, to in W.pieces(batch.column(0)):
            number, value, count = features(batch.column(0).slice(at, to - at), chars[at:to])
            cut = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).slice(at, to - at), pa.ListArray.from_arrays(cut, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value))], ["y", "number", "value"]
            )


def _scored(model_at):
    def run(batches):
        model = model_at.value
        for batch in batches:
            chars = batch.column(1).to_numpy(zero_copy_only=False)
            for at, to in W.pieces(batch.column(0)):
                z, _ = raw_scores(model, *features(batch.column(0).slice(at, to - at), chars[at:to]))
                rest = [batch.column(i).slice(at, to - at) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array((1 / (1 + np.exp(-np.clip(z, -30, 30)))).astype(np.float64))], [*batch.schema.names[2:], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", chars: str | None = "n_chars", sample: int = SAMPLE) -> dict:
    """A model from about `sample` labelled documents, and no more than twice that, chosen by a hash of their key; rows with a null label or key don't count. Of rows that share a key, in either table, the least counts once
    (label 0 before 1, and the text that sorts first), so copies of a key don't reach the driver."""
    set_up(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("y"))
    n = marks.agg(F.approx_count_distinct("_key", 0.02)).first()[0]
    marks = marks.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_003)) < min(1.0, sample / max(n, 1)) * 1_000_003).groupBy("_key").agg(F.min("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("_key"), "_key").limit(2 * sample)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), _chars(docs, chars), F.col(key).alias("_key")).join(F.broadcast(marks), "_key")
    rows = rows.groupBy("_key", "y").agg(F.min(F.struct("text", "chars")).alias("_first")).select("_first.text", "_first.chars", "y")
    got = rows.mapInArrow(released(_featured), "y int, number array<int>, value array<float>").toArrow()
    y = got.column("y").to_numpy().astype(np.float32)
    number, value = (got.column(c).combine_chunks() for c in ("number", "value"))
    count = np.asarray([len(x) for x in number.to_pylist()], np.int64) if len(y) else np.zeros(0, np.int64)
    # in an order of their own, so that a model doesn't hang on which task was first
    number, value = np.asarray(number.flatten()).astype(np.int64), np.asarray(value.flatten())
    begin = np.concatenate([[0], np.cumsum(count)])
    order = sorted(range(len(y)), key=lambda i: (count[i], number[begin[i] : begin[i + 1]].tobytes(), y[i]))
    place = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in order]) if order else np.zeros(0, np.int64)
    return train(number[place], value[place], count[order] if order else count, y[order] if order else y)


def _chars(docs: DataFrame, chars: str | None):
    known = F.coalesce(F.col(chars).cast("bigint"), F.lit(-1)) if chars and chars in docs.columns else F.lit(-1).cast("bigint")
    return known.alias("chars")


def quality(docs: DataFrame, model: dict, text: str = "text", chars: str | None = "n_chars", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of docs, with score (0 to 1, higher: better) and predicted (1 from LEAST up).

    Null texts count as empty, and empty ones get a score from their statistics; without any labels all scores are the same. Whole texts are read; repeated rows
    give repeated rows; an empty table an empty one.
    """
    set_up(docs.sparkSession)
    model_at = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), _chars(docs, chars), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)))
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    found = rows.mapInArrow(released(_scored(model_at)), ", ".join(filter(None, [kinds, "score double"])))
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))

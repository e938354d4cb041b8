"""Toxicity scores by two class-conditional Kneser-Ney models of bytes.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of byte n-grams up to ORDER, which cross words: stems, endings and phrases alike. Counts of n-grams longer than SHARED bytes are a
class's own; the shorter ones are counted over both classes together. A rare expression thus falls back, in either model, to the same shared counts and says little, while one that only toxic texts hold keeps its weight.

A byte's evidence is log P(byte | before, toxic) - log P(byte | before, ordinary). A text is judged by length-normalised sums of it: over the whole text, and over its most toxic passages of PASSAGES bytes, so that
an insult in a long text isn't diluted. A logistic function of these and of the length, fitted on texts that the models which score them haven't seen (two folds), gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.shared import numbered, released, renamed, set_up, with_fields, written

ORDER = 5
SHARED = 2
#: Labelled documents of each class that the models are fitted on (about so many, at most twice that).
PER_CLASS = 4000
PASSAGES = (24, 64, 256)
LEAST = 0.5
U = np.uint64
#: A-Z in lower case, white space as a space.
PLAIN = W.LOWER.copy()
PLAIN[~W.SPACED] = 32


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(each byte with the ORDER - 1 before it as one integer, offsets of the texts). The last byte stands highest, so the n-gram that ends there is the integer's highest n bytes; before a text there are spaces."""
    data, offsets = W.bytes_of(column)
    data = PLAIN[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(data), U)
    for j in range(ORDER):
        before = np.full(len(data), 32, U)
        before[j:] = data[: len(data) - j] if j else data
        before[place < j] = 32
        out |= before << U(8 * (ORDER - 1 - j))
    return out, offsets


def _suffix(keys: np.ndarray, n: int, of: int = ORDER) -> np.ndarray:
    return keys >> U(8 * (of - n))


def _history(keys: np.ndarray, n: int) -> np.ndarray:
    """Of n-grams, what stands before the last byte."""
    return keys & U((1 << (8 * (n - 1))) - 1)


def _level(keys: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams with counts: (keys, their share after the discount, histories, weight left for the shorter model, total)."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    histories, at = np.unique(_history(keys, n), return_inverse=True)
    total = np.bincount(at, counts, len(histories))
    kinds = np.bincount(at, minlength=len(histories))
    return keys, np.maximum(counts - discount, 0) / total[at], histories, discount * kinds / np.maximum(total, 1)


def _at(table: np.ndarray, keys: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    """The values of keys in a sorted table, and `other` for those that aren't there."""
    if not len(table):
        return np.full(len(keys), other)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[place] == keys, values[place], other)


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
    """Levels 1 to ORDER of each class's model, from (sorted longest n-grams, counts) of each class. A level: (n-grams, discounted shares, histories, weights of the shorter model)."""
    pooled = np.unique(np.concatenate([k for k, _ in counts]))
    models = []
    for keys, own in counts:
        levels = []
        for n in range(1, ORDER):
            longer = np.unique(_suffix(pooled if n <= SHARED else keys, n + 1))
            levels.append(_level(*np.unique(longer >> U(8), return_counts=True), n))
        models.append([*levels, _level(keys, own, ORDER)])
    return models


def log_likelihood(levels: list[tuple], keys: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each key's last byte after those before it. A history that was never seen leaves all to the shorter model; below the first level all bytes are alike."""
    p = np.full(len(keys), 1 / 256)
    for n, (known, share, histories, left) in enumerate(levels, 1):
        own = _suffix(keys, n)
        p = _at(known, own, share, 0.0) + _at(histories, _history(own, n), left, 1.0) * p
    return np.log(p)


def evidence(models: list[list[tuple]], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood ratio of each byte, offsets of the texts)."""
    keys, offsets = grams(column)
    kinds, at = np.unique(keys, return_inverse=True)
    return (log_likelihood(models[1], kinds) - log_likelihood(models[0], kinds))[at], offsets


def measures(models: list[list[tuple]], column: pa.Array) -> np.ndarray:
    """One row for each text: its evidence for each byte, that of its most toxic passage of each length, and its length (log2). A shorter text is one passage; an empty one has zeros."""
    ratio, offsets = evidence(models, column)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    size = np.diff(offsets)
    out = np.zeros((len(size), len(PASSAGES) + 2))
    out[:, 0] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
    live = np.flatnonzero(size)
    ends = np.repeat(offsets[1:], size)
    for i, length in enumerate(PASSAGES, 1):
        begin = np.arange(len(ratio))
        stop = np.minimum(begin + length, ends)
        begin = np.maximum(np.minimum(begin, stop - length), np.repeat(offsets[:-1], size))
        if len(live):
            out[live, i] = np.maximum.reduceat((total[stop] - total[begin]) / length, offsets[:-1][live])
    out[:, -1] = np.log2(size + 1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the constant first) of a logistic regression by Newton's method."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def score(model: dict, column: pa.Array) -> np.ndarray:
    mean, scale, w = model["logistic"]
    z = (measures(model["levels"], column) - mean) / scale
    return 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -30, 30)))


def _counted(batches):
    """Of (y, fold, text): counts of n-grams by class and fold, summed within each piece."""
    for batch in batches:
        group = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        for g in np.unique(group):
            texts = batch.column(2).filter(pa.array(group == g))
            for at, to in W.pieces(texts):
                keys, n = np.unique(grams(texts.slice(at, to - at))[0], return_counts=True)
                size = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, g // 2, np.int32)), pa.array(np.full(size, g % 2, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["y", "fold", "gram", "n"])


def _measured(models_at):
    """Of (y, fold, text): the measures by the models of the other fold."""

    def run(batches):
        for batch in batches:
            fold = batch.column(1).to_numpy()
            for f in (0, 1):
                mine = batch.filter(pa.array(fold == f))
                for at, to in W.pieces(mine.column(2)):
                    found = measures(models_at.value[1 - f], mine.column(2).slice(at, to - at))
                    yield pa.RecordBatch.from_arrays([mine.column(0).slice(at, to - at), pa.array(found.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min((F.col(label) > 0).cast("int")).alias("y"))
    size = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, n in size.items():
        own = marks.where((F.col("y") == y) & (F.pmod(F.xxhash64("_key"), F.lit(1_000_003)) < min(1.0, per_class / n) * 1_000_003)).orderBy(F.xxhash64("_key"), "_key").limit(2 * per_class)
        chosen = own if chosen is None else chosen.union(own)
    if chosen is None:
        chosen = marks.limit(0)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("_key")).join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key", "y").agg(F.min("text").alias("text")).groupBy("text").agg(F.min("y").alias("y"))
    return rows.select("y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "text"), size


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = PER_CLASS) -> dict:
    """Models and logistic function from about per_class labelled documents of each class, at most twice that, chosen by a hash of their key; rows with a null label or key don't count. Of rows that share a key, in either table, the
    least counts once, and equal texts count once, so copies neither weigh nor reach the driver. Counts are made in tasks; the driver gets one row for each n-gram of the sample."""
    set_up(docs.sparkSession)
    sample, size = _sample(docs, labels, text, label, key, per_class)
    sample = written(sample, "toxicity-sample")
    got = sample.mapInArrow(released(_counted), "y int, fold int, gram bigint, n bigint").groupBy("y", "fold", "gram").agg(F.sum("n").alias("n")).toArrow()
    y, fold, gram, n = (got.column(c).to_numpy() for c in ("y", "fold", "gram", "n"))
    gram = gram.view(U)

    def counts(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(gram[mine], return_inverse=True)
        return keys, np.bincount(at, n[mine], len(keys))

    apart = [kneser_ney([counts((y == k) & (fold == f)) for k in (0, 1)]) for f in (0, 1)]
    levels = kneser_ney([counts(y == k) for k in (0, 1)])
    apart_at = docs.sparkSession.sparkContext.broadcast(apart)
    rows = sample.mapInArrow(released(_measured(apart_at)), "y int, x array<double>").toArrow()
    apart_at.unpersist()
    own = rows.column("y").to_numpy()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(own), len(PASSAGES) + 2)
    order = np.lexsort((*x.T, own))
    own, x = own[order], x[order]
    weight = np.array([size.get(k, 0) / max(int((own == k).sum()), 1) for k in (0, 1)])
    weight = (weight / max(weight.sum(), 1e-9) * 2)[own] if len(own) else np.zeros(0)
    return {"levels": levels, "logistic": logistic(x, own.astype(float), weight)}


def _scored(model_at):
    def run(batches):
        for batch in batches:
            for at, to in W.pieces(batch.column(0)):
                rest = [batch.column(i).slice(at, to - at) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score(model_at.value, batch.column(0).slice(at, to - at)))], [*batch.schema.names[1:], "score"])

    return run


def toxicity(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of docs, with score (0 to 1, higher: more likely toxic) and predicted (1 from LEAST up).

    Whole texts are read. Null texts count as empty, and empty ones have no evidence, so they get the score of no measures; without labels all scores are .5. Repeated rows give repeated rows, an empty table an empty one;
    other columns aren't read, whatever their names.
    """
    set_up(docs.sparkSession)
    model_at = docs.sparkSession.sparkContext.broadcast(model)
    own, fields = numbered(docs, keep)
    found = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), *own).mapInArrow(released(_scored(model_at)), with_fields(fields, "score double"))
    return found.select(*renamed(found, keep), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))

"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window (A-Z in lower case); a filter's largest response over the window, not below 0, is a
feature, and a softmax over these gives the window's languages. A text's probabilities are the mean over all its windows, weighted by
their bytes. Trained in numpy by Adam on the driver with a bounded sample; the backward pass touches only the bytes that won the pooling.

For scoring, a filter of width 2 becomes a table over byte pairs, and wider ones sums of two tables, so a response is one or two row look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.shared import numbered, released, renamed, set_up, with_fields

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 512
PER_LANGUAGE = 800
UNKNOWN = "und"


def _responses(x: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """x: windows of bytes. One array (window, place, filter) for each width."""
    out = []
    for f in filters:
        n = x.shape[1] - len(f) + 1
        r = f[0][x[:, :n]]
        for j in range(1, len(f)):
            r += f[j][x[:, j : j + n]]
        out.append(r)
    return out


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict:
    """x: (windows, bytes) uint8; y: class numbers. Returns filters (one (width, 256, FILTERS) for each width), out, bias."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
    weights = [*filters, out, np.zeros(classes, np.float32)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for at in range(0, len(x), batch) if len(x) else ():
            if not at:
                order = rng.permutation(len(x))
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            best, where = [], []
            for r in _responses(xb, weights[: len(WIDTHS)]):
                a = r.argmax(1)
                where.append(a)
                best.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
            h = np.maximum(np.concatenate(best, 1), 0)
            z = h @ weights[-2] + weights[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            back = (p @ weights[-2].T) * (h > 0)
            grads = [np.zeros_like(w) for w in weights[: len(WIDTHS)]] + [h.T @ p, p.sum(0)]
            rows, cols = np.arange(len(xb))[:, None], np.arange(FILTERS)[None, :]
            for i, a in enumerate(where):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(WIDTHS[i]):
                    np.add.at(grads[i][j], (xb[rows, a + j], np.broadcast_to(cols, a.shape)), g)
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"filters": weights[: len(WIDTHS)], "out": weights[-2], "bias": weights[-1]}


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all windows of all texts, the text of each, its bytes); the last window of a text is filled up with 0."""
    size = np.diff(offsets)
    n = -(-size // width)
    text = np.repeat(np.arange(len(size)), n)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1] * width
    flat = np.zeros(int(n.sum()) * width, np.uint8)
    flat[np.arange(len(data)) + np.repeat(begin - offsets[:-1], size)] = W.LOWER[data]
    used = np.minimum(width, np.repeat(size, n) - (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * width)
    return flat.reshape(-1, width), text, used


class Scorer:
    def __init__(self, model: dict) -> None:
        two, three, four = model["filters"]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.two, self.three, self.four = pair(*two), (pair(*three[:2]), three[2]), (pair(*four[:2]), pair(*four[2:]))
        self.out, self.bias = model["out"], model["bias"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        wide = x.astype(np.int32)
        p = (wide[:, :-1] << 8) | wide[:, 1:]
        h = [self.two[p].max(1)]
        r = self.three[0][p[:, :-1]]
        r += self.three[1][wide[:, 2:]]
        h.append(r.max(1))
        r = self.four[0][p[:, :-2]]
        r += self.four[1][p[:, 2:]]
        h.append(r.max(1))
        z = np.maximum(np.concatenate(h, 1), 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _predict(model_at, names: list[str], keep: list[int]):
    """keep: places of the columns that are returned; the first column is the text."""

    def run(batches):
        score = Scorer(model_at.value) if names else None
        for batch in batches:
            label, best = [], []
            texts, letters = batch.column(0), np.asarray(batch.column(1).to_pylist(), bool)
            for at, to in W.pieces(texts, 1 << 16):
                total = np.zeros((to - at, max(1, len(names))))
                if names:
                    x, text, used = windows(*W.bytes_of(texts.slice(at, to - at)))
                    for i in range(0, len(x), 256):
                        np.add.at(total, text[i : i + 256], score(x[i : i + 256]) * used[i : i + 256, None])
                    total /= np.maximum(np.bincount(text, used, to - at), 1)[:, None]
                known = letters[at:to] & bool(names)
                pick = total.argmax(1)
                label += [names[k] if ok else UNKNOWN for k, ok in zip(pick.tolist(), known.tolist(), strict=True)]
                best.append(np.where(known, np.minimum(total.max(1), 1), 0))
            if batch.num_rows:
                names_out = [*(f"_{i}" for i in range(len(keep))), "lang_pred", "score"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(label, pa.string()), pa.array(np.concatenate(best))], names_out)

    return run


def fit(labelled: DataFrame, text: str, lang: str, per_language: int = PER_LANGUAGE) -> tuple[list[str], dict]:
    """(languages, model) from about per_language different texts of each language, and no more than twice that, chosen by a hash of the text; of each, one window's bytes from a
    place that the hash chooses, so that about languages * per_language * WINDOW bytes reach the driver. A language's share of rows doesn't matter, nor do copies of a text."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return [], {}
    share = F.create_map(*[F.lit(v) for name in names for v in (name, min(1.0, per_language / max(counts[name], 1)))])
    rows = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    at = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1)))
    some = rows.select("lang", "h", F.substring(F.col("text"), at.cast("int"), F.lit(WINDOW)).alias("text")).dropDuplicates(["lang", "h"])
    got = some.orderBy("h", "lang").limit(2 * per_language * len(names)).select("lang", "text").collect()
    got.sort()
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, r in enumerate(got):
        b = np.frombuffer(r["text"].encode()[:WINDOW], np.uint8)
        x[i, : len(b)] = W.LOWER[b]
    y = np.array([names.index(r["lang"]) for r in got], np.int64)
    return names, train(x, y, len(names))


def _found(docs: DataFrame, labelled: DataFrame, text: str, lang: str, keep: list[str] | tuple[str, ...]) -> DataFrame:
    """The columns `keep` as _0 and so on, lang_pred and score."""
    set_up(docs.sparkSession)
    names, model = fit(labelled, text, lang)
    model_at = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in keep if c != text]  # a text that is kept goes to Python and back once
    own = [F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")]
    rows = docs.select(*own, *numbered(docs, others)[0])
    places = [0 if c == text else 2 + others.index(c) for c in keep]
    return rows.mapInArrow(released(_predict(model_at, names, places)), with_fields(numbered(docs, keep)[1], "lang_pred string, score double"))


def languages(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of docs, with lang_pred (a language of `labelled`) and score (its probability, 0 to 1).

    A text that is null or has no letter, and every text if nothing is labelled, gets `und` and 0. Only the text is an input. Texts of any length are read whole, window by
    window; repeated rows give repeated rows; an empty table an empty one. Columns of `keep` may have any names; lang_pred and score come after them.
    """
    found = _found(docs, labelled, text, lang, keep)
    return found.select(*renamed(found, keep), "lang_pred", "score")


def known_languages(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language isn't `und`, with all their columns, whatever their names. A row is judged by its own text alone, so null and repeated ids don't matter."""
    found = _found(docs, labelled, text, lang, docs.columns)
    found = found.where(found.lang_pred != UNKNOWN)
    return found.select(renamed(found, docs.columns))

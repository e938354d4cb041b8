"""Language-model scores by masked pseudo-likelihood.

A word counts as one of VOCABULARY tokens: the most frequent words of the whole corpus have tokens of their own, all others share the rest by their last ENDING bytes, which a context can tell something about (a
language, a word class), as it can't about a hash of the whole word. A network with one hidden layer sees SIDE words on either side of a masked word and predicts its token in two steps, the token's group and then its place in the group:

    h = tanh(W [e(left words), e(right words)] + b);  p(token) = softmax(G h + c)[group] * softmax(P (h + u(group)) + d(group))[place]

Which word of a shared token's it is follows from the words' counts alone, p(word | token) = n(word) / (n(token) + 1), where all words that were never counted share the count of 1. A word with a token of its own has 1.

A document's score is the sum of log p(token) + log p(word | token) over all its words, each predicted from both sides. The counts of the commonest words, at most LISTED, go to every task; those of all others are joined by hash.

Words are counted over all documents, and c and d start from these counts. Training goes over all windows of all documents: in round r every task trains, from the weights of the round before, on the documents whose text's hash leaves r when divided by the
number of rounds, so that each window is used in one round, however rows are batched. The tasks' weights are averaged by blocks in Spark, in two steps so that no task gathers all; only the average, of fixed size, reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.shared import released, set_up, text_of, written

GROUPS, PLACES = 64, 64
VOCABULARY = GROUPS * PLACES
OWN = VOCABULARY // 2  # token 0 stands beyond the ends of a text, 1 to OWN - 1 are words, the rest are shared
SIDE, WIDTH, HIDDEN = 2, 16, 24
ENDING = 2
#: A word's key: its class, which is its place among the shared tokens, above so many bits of its hash.
HASH_BITS = 64 - int(VOCABULARY - OWN - 1).bit_length()
ROUNDS, BATCH, RATE = 2, 512, 0.2
BLOCK = 8192
LISTED = 1 << 18
SPREAD = 32
SHAPES = {"e": (VOCABULARY, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "g": (HIDDEN, GROUPS), "gb": (GROUPS,), "u": (GROUPS, HIDDEN), "p": (HIDDEN, PLACES), "pb": (GROUPS, PLACES)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def start(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights that give every token its share of counts, whatever stands around it."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    m = views(flat)
    for name in ("e", "w", "g", "p"):
        m[name][...] = rng.normal(0, 0.3 if name == "e" else 0.3 / np.sqrt(SHAPES[name][0]), SHAPES[name])
    share = (counts + 1.0).reshape(GROUPS, PLACES)
    m["gb"][...] = np.log(share.sum(1) / share.sum())
    m["pb"][...] = np.log(share / share.sum(1, keepdims=True))
    return flat


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def word_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words as 64-bit keys, from the class of their endings and a hash of all their bytes, A-Z in lower case."""
    ending = np.zeros(len(begin), np.uint64)
    for j in range(1, ENDING + 1):
        at = end - j
        ending = ending * np.uint64(257) + np.where(at >= begin, W.LOWER[data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(data) else ending
    bits = np.uint64(HASH_BITS)
    return ((W.mix(ending) % np.uint64(VOCABULARY - OWN)) << bits) | (W.word_hashes(data, begin, end) & ((np.uint64(1) << bits) - np.uint64(1)))


def tokens_of(keys: np.ndarray, top: np.ndarray) -> np.ndarray:
    """top: sorted keys of the words with tokens of their own, at most OWN - 1."""
    out = OWN + (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    if len(top):
        place = np.minimum(np.searchsorted(top, keys), len(top) - 1)
        out = np.where(top[place] == keys, place + 1, out)
    return out


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(word, 2 * SIDE): the tokens left of each word, then right of it, 0 beyond its text."""
    text = np.repeat(np.arange(len(counts)), counts)
    padded, own = np.concatenate([np.zeros(SIDE, np.int64), tokens, np.zeros(SIDE, np.int64)]), np.concatenate([np.full(SIDE, -1), text, np.full(SIDE, -1)])
    n = len(tokens)
    return np.stack([np.where(own[SIDE + d : SIDE + d + n] == text, padded[SIDE + d : SIDE + d + n], 0) for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)


class Model:
    """Log-probabilities with what doesn't hang on the context worked out beforehand."""

    def __init__(self, flat: np.ndarray) -> None:
        m = views(flat)
        self.e, self.w, self.b, self.gb = m["e"], m["w"], m["b"], m["gb"]
        self.out = np.ascontiguousarray(np.concatenate([m["g"], m["p"]], 1))
        self.place = m["u"] @ m["p"] + m["pb"]

    def __call__(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.e[around].reshape(len(around), -1) @ self.w
        h += self.b
        np.tanh(h, out=h)
        z = h @ self.out
        group, row = target // PLACES, np.arange(len(target))
        z[:, :GROUPS] += self.gb
        z[:, GROUPS:] += self.place[group]
        np.clip(z, -80, 80, out=z)
        said = z[row, group].astype(np.float64) + z[row, GROUPS + target % PLACES]
        np.exp(z, out=z)
        return said - np.log(z[:, :GROUPS].sum(1), dtype=np.float64) - np.log(z[:, GROUPS:].sum(1), dtype=np.float64)


def _sums(of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different values of `of`, sums of the rows of each)."""
    order = np.argsort(of, kind="stable")  # a radix sort of small integers
    sorted_ = of[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(rows[order], first)


def train(flat: np.ndarray, around: np.ndarray, target: np.ndarray, seen: np.ndarray) -> None:
    """One pass of Adagrad over the windows, in place; seen: sums of squared gradients so far, above 0."""
    m, s = views(flat), views(seen)
    out, seen_out = (np.ascontiguousarray(np.concatenate([x["g"], x["p"]], 1)) for x in (m, s))  # both softmaxes by one product
    around, group, place = around.astype(np.uint16), (target // PLACES).astype(np.uint8), target % PLACES
    for at in range(0, len(target), BATCH):
        a, own, there = around[at : at + BATCH], group[at : at + BATCH], place[at : at + BATCH]
        n = len(a)
        row = np.arange(n)
        x = m["e"][a].reshape(n, -1)
        h = x @ m["w"]
        h += m["b"]
        np.tanh(h, out=h)
        z = h @ out
        z[:, :GROUPS] += m["gb"]
        z[:, GROUPS:] += (m["u"] @ out[:, GROUPS:] + m["pb"])[own]
        np.clip(z, -80, 80, out=z)
        np.exp(z, out=z)
        for half in (z[:, :GROUPS], z[:, GROUPS:]):
            half /= half.sum(1, keepdims=True) * np.float32(n)
        z[row, own] -= np.float32(1 / n)
        z[row, GROUPS + there] -= np.float32(1 / n)
        back = (z @ out.T) * (1 - h * h)
        groups, d_places = _sums(own, z[:, GROUPS:])
        tokens, d_tokens = _sums(a.ravel(), (back @ m["w"].T).reshape(-1, WIDTH))
        d_out = h.T @ z
        d_out[:, GROUPS:] += m["u"][groups].T @ d_places
        for weights, sums, rows, d in ((m["u"], s["u"], groups, d_places @ out[:, GROUPS:].T), (m["pb"], s["pb"], groups, d_places), (m["e"], s["e"], tokens, d_tokens)):
            so_far = sums[rows] + d * d
            sums[rows] = so_far
            weights[rows] -= RATE * d / np.sqrt(so_far)
        for weights, sums, d in ((out, seen_out, d_out), (m["w"], s["w"], x.T @ back), (m["gb"], s["gb"], z[:, :GROUPS].sum(0)), (m["b"], s["b"], back.sum(0))):
            sums += d * d
            weights -= RATE * d / np.sqrt(sums)
    for x, whole in ((m, out), (s, seen_out)):
        x["g"][...], x["p"][...] = whole[:, :GROUPS], whole[:, GROUPS:]


def _worded(column: pa.Array):
    for at, to in W.pieces(column):
        data, offsets = W.bytes_of(column.slice(at, to - at))
        begin, end, n = W.spans(data, offsets, W.SPACED)
        yield at, to, word_keys(data, begin, end), n


def _counts(batches):
    for batch in batches:
        found = [h for _, _, h, _ in _worded(batch.column(0))]
        if found:
            words, n = np.unique(np.concatenate(found), return_counts=True)
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], ["word", "n"])


def _trained(top_at, flat_at):
    def run(batches):
        from pyspark import TaskContext

        top, flat, seen, windows = top_at.value, flat_at.value.copy(), np.full(SIZE, 0.01, np.float32), 0
        for batch in batches:
            for _, _, hashes, n in _worded(batch.column(0)):
                tokens = tokens_of(hashes, top)
                train(flat, contexts(tokens, n), tokens, seen)
                windows += len(tokens)
        if windows:
            part = TaskContext.get().partitionId()
            weighted = flat.astype(np.float64) * windows
            for block in range(-(-SIZE // BLOCK)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part % SPREAD]), pa.array([windows]), pa.array([weighted[block * BLOCK : (block + 1) * BLOCK].tobytes()], pa.binary())], ["block", "spread", "windows", "sums"]
                )

    return run


def _summed(batches):
    sums: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["block"], r["spread"])
            n, total = sums.get(key, (0, 0.0))
            sums[key] = (n + r["windows"], total + np.frombuffer(r["sums"]))
    for (block, spread), (n, total) in sorted(sums.items()):
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([spread]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["block", "spread", "windows", "sums"])


def _token_counts(top_at):
    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            total += np.bincount(tokens_of(np.asarray(batch.column(0)).view(np.uint64), top_at.value), np.asarray(batch.column(1)), VOCABULARY).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["token", "n"])

    return run


PARTS = "block bigint, spread bigint, windows bigint, sums binary"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the keys of all words of docs, and how often each occurs."""
    set_up(docs.sparkSession)
    rows = docs.select(text_of(text).alias("text"))
    return written(rows.mapInArrow(released(_counts), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def of_round(rows: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The documents whose windows a round trains on. All rounds together use each document once."""
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)


def token_counts(counts: DataFrame, top_at) -> np.ndarray:
    out = np.zeros(VOCABULARY)
    for r in counts.mapInArrow(released(_token_counts(top_at)), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys of the words with tokens of their own, weights) from all documents. Equally frequent words are taken by their key. counts: word_counts of docs, if they are there already."""
    set_up(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(text_of(text).alias("text"))
    counts = word_counts(docs, text) if counts is None else counts
    top = np.sort(np.array([r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(OWN - 1).collect()], np.int64).view(np.uint64))
    top_at = sc.broadcast(top)
    flat = start(token_counts(counts, top_at))
    for turn in range(rounds):
        each = of_round(rows, turn, rounds).mapInArrow(released(_trained(top_at, sc.broadcast(flat))), PARTS)
        some = each.repartition(SPREAD, "block", "spread").mapInArrow(released(_summed), PARTS).withColumn("spread", F.lit(0).cast("bigint"))
        whole = {r["block"]: np.frombuffer(r["sums"]) / r["windows"] for r in some.repartition(8, "block").mapInArrow(released(_summed), PARTS).collect()}
        if whole:
            flat = np.concatenate([whole[b] for b in sorted(whole)]).astype(np.float32)
    return top, flat


def listed_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted keys of at most LISTED words, their counts, least): all words that occur least times or more. Below 2, words beyond them occur once at most."""
    least, so_far = 1, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        so_far += r["words"]
        if so_far > LISTED:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= max(least, 2)).select("word", "n").toArrow()
    words, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(words)
    return words[order], n[order], least


def in_token(hashes: np.ndarray, tokens: np.ndarray, listed: np.ndarray, logs: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log p(word | token) of each word, with a count of 1 for words that aren't listed; which words of shared tokens aren't listed). logs: of the listed words' counts; whole: log(n(token) + 1)."""
    out, shared = np.zeros(len(hashes)), np.flatnonzero(tokens >= OWN)
    out[shared] = -whole[tokens[shared]]
    if not len(listed):
        return out, shared
    own = hashes[shared]
    place = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
    known = listed[place] == own
    out[shared[known]] += logs[place[known]]
    return out, shared[~known]


def _scored(model_at, apart: bool):
    def run(batches):
        from pyspark import TaskContext

        top, flat, *counted = model_at.value
        model, key = Model(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to, hashes, n in _worded(batch.column(0)):
                tokens = tokens_of(hashes, top)
                around = contexts(tokens, n)
                total, rest = in_token(hashes, tokens, *counted)
                for i in range(0, len(tokens), 4096):
                    total[i : i + 4096] += model(around[i : i + 4096], tokens[i : i + 4096])
                first = np.concatenate([[0], np.cumsum(n)])
                ends = np.concatenate([[0.0], np.cumsum(total)])[first]
                out = {c: batch.column(i).slice(at, to - at) for i, c in enumerate(batch.schema.names) if i} | {"n_words": pa.array(n.astype(np.int64)), "log_likelihood": pa.array(np.diff(ends))}
                if apart:
                    out |= {"_key": pa.array(key + np.arange(to - at)), "_rest": pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, first).astype(np.int32)), pa.array(hashes[rest].view(np.int64)))}
                    key += to - at
                yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return run


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, log_likelihood (sum over words, 0 without any), mean_log_likelihood (null without any).

    counts: word_counts of the documents that the model is from; without it, words are counted over docs. Words are parted by \\x20 and \\x09-\\x0D and A-Z count as a-z. Null and empty texts have no words; texts of any length
    are read whole; repeated rows give repeated rows; an empty table an empty one, and a model of one keeps its starting weights. Other columns aren't read.
    """
    set_up(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    counts = word_counts(docs, text) if counts is None else counts
    top, flat = model
    whole = np.log(token_counts(counts, sc.broadcast(top)) + 1)
    listed, n, least = listed_counts(counts)
    apart = least > 2
    model_at = sc.broadcast((top, flat, listed, np.log(n), whole))
    rows = docs.select(text_of(text).alias("text"), F.col(doc_id).alias("doc_id"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, log_likelihood double"
    found = rows.mapInArrow(released(_scored(model_at, apart)), schema + (", _key bigint, _rest array<bigint>" if apart else ""))
    if apart:
        found = written(found, "token-scores")
        others = found.select("_key", F.explode("_rest").alias("word")).join(counts.where((F.col("n") > 1) & (F.col("n") < least)), "word")
        more = others.groupBy("_key").agg(F.sum(F.log(F.col("n").cast("double"))).alias("_more"))
        found = found.join(more, "_key", "left").select("doc_id", "n_words", (F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0))).alias("log_likelihood"))
    return found.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", F.nullif("n_words", F.lit(0).cast("bigint"))))

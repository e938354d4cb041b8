"""Benchmark decontamination with an FM-index for each shard of the training texts.

A task cuts its rows into shards of bounded size and indexes each: words become symbols (words that no phrase has only part segments), the suffix array of the segments is sorted
by prefix doubling, and the Burrows-Wheeler transform goes into a wavelet matrix, whose ranks drive the backward search of all phrases at
once. Matched rows walk back to sampled suffix positions, which name documents and words; a document's occurrences merge into removal spans.
Segments shorter than the shortest phrase can't hold one and are left out. Nothing is shuffled.

The phrases of a block of benchmark items are broadcast; a block's size is bounded (phrase_bytes), and a larger benchmark takes several passes over the rows, which carry what earlier passes found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.shared import numbered, released, renamed, set_up, text_of, with_fields, written

SAMPLE = 8
#: Bytes of text in a shard: at least, at most, and for each byte of phrases in between. All phrases are searched in each shard, so many phrases want large shards.
SHARD_LEAST, SHARD_MOST, SHARD_SHARE = 4 << 20, 24 << 20, 2
#: Rows that go back to Spark at once, and words of a piece of a long item.
OUT_ROWS, PIECE_WORDS = 1000, 1 << 15


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; each round sorts by twice as many values as the last."""
    n, key, step = len(values), values, 1
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        if fresh.all():
            return order
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(fresh) - 1
        beyond = np.zeros(n, np.int64)
        beyond[: n - step] = dense[step:] + 1
        key = dense * (n + 1) + beyond
        step *= 2


class WaveletMatrix:
    """Ranks of integer symbols: for each bit, from the highest, how many zeros come before each place."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.zeros = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            symbols = symbols[np.argsort(bit, kind="stable")]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin = np.zeros_like(place)
        for level, before in enumerate(self.zeros):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            at, to = before[begin].astype(np.int64), before[place].astype(np.int64)
            begin, place = np.where(one, before[-1] + begin - at, at), np.where(one, before[-1] + place - to, to)
        return place - begin


class FMIndex:
    """Over segments of symbols from 1 up. text: the segments, each followed by a 0."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        parts = text == 0
        n_parts = int(parts.sum())
        suffixes = suffix_array(np.where(parts, np.cumsum(parts) - 1, text + n_parts))  # every end of a segment is a symbol of its own
        self.n = len(text)
        self.bwt = text[suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        self.tree = WaveletMatrix(self.bwt, int(top + 1).bit_length())
        opens = np.zeros(self.n, bool)
        opens[0] = True
        opens[1:] = parts[:-1]
        self.sampled = (suffixes % SAMPLE == 0) | opens[suffixes]
        self.position = np.where(self.sampled, suffixes, -1)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases: one in each row, right-aligned, 0 before its start."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, j] > 0) & (low < high))
            if len(live):
                c = phrases[live, j]
                low[live], high[live] = self.step(c, low[live]), self.step(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, found = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            here = self.sampled[rows[todo]]
            done = todo[here]
            found[done] = self.position[rows[done]] + steps[done]
            todo = todo[~here]
            rows[todo] = self.step(self.bwt[rows[todo]], rows[todo])
            steps[todo] += 1
        return found


def phrase_table(items: list[tuple[str, str]], length: int) -> dict:
    """Windows of `length` consecutive words of each item (an item of fewer, but not none, is one window), as symbols of the items' own words."""
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    column = pa.array([text for _, text in items], pa.large_string())
    data, offsets = W.bytes_of(column)
    start, end, n = W.spans(data, offsets, W.ALNUM)
    words = W.word_hashes(data, start, end)
    vocabulary, symbols = np.unique(words, return_inverse=True)
    symbols = symbols + 1
    windows: dict[tuple, set] = {}
    at = 0
    for (name, _), k in zip(items, n.tolist(), strict=True):
        own = symbols[at : at + k].tolist()
        at += k
        for i in range(max(1, k - length + 1) if k else 0):
            windows.setdefault(tuple(own[i : i + length]), set()).add(number[name])
    phrases = np.zeros((len(windows), length), np.int64)
    for i, w in enumerate(windows):
        phrases[i, length - len(w) :] = w
    of = [sorted(x) for x in windows.values()]
    return {
        "names": names,
        "vocabulary": vocabulary,
        "phrases": phrases,
        "lengths": np.array([len(w) for w in windows], np.int64),
        "owner_at": np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64),
        "owners": np.array([i for x in of for i in x], np.int64),
    }


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of the next."""
    total = np.concatenate([[0], np.cumsum(count)])
    return np.arange(total[-1]) - np.repeat(total[:-1], count) + np.repeat(begin, count)


def _shard(symbols: np.ndarray, n_words: np.ndarray, table: dict) -> tuple[list, list]:
    """For each text of a shard: merged spans of hit words as (start, end), and the numbers of the items that occur."""
    spans: list = [[] for _ in n_words]
    owners: list = [[] for _ in n_words]
    shortest = int(table["lengths"].min()) if len(table["lengths"]) else 0
    first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
    known = symbols > 0
    if not shortest or not known.any():
        return spans, owners
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    heads = first[:-1][n_words > 0]
    opens[heads] = known[heads]
    begin = np.flatnonzero(opens)
    stop = np.flatnonzero(~known)
    bound = np.minimum(np.append(stop, len(symbols))[np.searchsorted(stop, begin)], first[np.searchsorted(first, begin, "right")])
    length = bound - begin
    begin, length = begin[length >= shortest], length[length >= shortest]
    if not len(begin):
        return spans, owners
    place = _spread(begin, length + 1)  # one more, which becomes the segment's end
    text = np.where(_spread(np.zeros_like(length), length + 1) == np.repeat(length, length + 1), 0, symbols[np.minimum(place, len(symbols) - 1)])
    index = FMIndex(text, len(table["vocabulary"]))
    low, high = index.search(table["phrases"])
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return spans, owners
    times = high[hit] - low[hit]
    phrase = np.repeat(hit, times)
    word = place[index.locate(_spread(low[hit], times))]
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + table["lengths"][phrase], -1)
    covered = np.cumsum(change[:-1]) > 0
    text_of_word = np.searchsorted(first, word, "right") - 1
    n_names = len(table["names"])
    n_owners = np.diff(table["owner_at"])[phrase]
    pairs = np.unique(np.repeat(text_of_word, n_owners) * n_names + table["owners"][_spread(table["owner_at"][:-1][phrase], n_owners)])
    for t, o in zip((pairs // n_names).tolist(), (pairs % n_names).tolist(), strict=True):
        owners[t].append(o)
    for t in np.unique(text_of_word).tolist():
        c = np.concatenate([[False], covered[first[t] : first[t + 1]], [False]])
        edges = np.flatnonzero(c[1:] != c[:-1])
        spans[t] = [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return spans, owners


OUT = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _gathered(batches, most: int):
    """Batches of about so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def merged(spans: list[dict]) -> list[dict]:
    """Spans of words by start; those that overlap or touch become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def _search(table_at, keep: list[int], earlier: bool, clean_only: bool):
    """keep: places of the columns that are returned; the first column is the text. earlier: the last two columns are the spans and items of earlier passes."""

    def run(batches):
        table = table_at.value
        vocabulary = table["vocabulary"]
        names = table["names"]
        shard_bytes = min(max(SHARD_LEAST, SHARD_SHARE * table["phrases"].nbytes), SHARD_MOST)
        for batch in _gathered(batches, shard_bytes):
            texts = batch.column(0)
            for at, to in W.pieces(texts, shard_bytes):
                symbols, counts = [], []
                shard = texts.slice(at, to - at)
                for a, b in W.pieces(shard):
                    data, offsets = W.bytes_of(shard.slice(a, b - a))
                    start, end, n = W.spans(data, offsets, W.ALNUM)
                    words = W.word_hashes(data, start, end)
                    if len(vocabulary):
                        where = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                        symbols.append(np.where(vocabulary[where] == words, where + 1, 0))
                    else:
                        symbols.append(np.zeros(len(words), np.int64))
                    counts.append(n)
                n_words = np.concatenate(counts)
                spans, owners = _shard(np.concatenate(symbols), n_words, table)
                items = [[names[o] for o in x] for x in owners]
                if earlier:
                    before, had = (batch.column(i).slice(at, to - at).to_pylist() for i in (-2, -1))
                    spans = [merged(x + y) if x and y else x or y for x, y in zip(before, spans, strict=True)]
                    items = [sorted({*x, *y}) for x, y in zip(had, items, strict=True)]
                columns = [*(batch.column(i).slice(at, to - at) for i in keep), pa.array(n_words.astype(np.int64)), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(columns, [*(f"_{i}" for i in range(len(keep))), "n_words", "spans", "items"])
                if clean_only:
                    out = out.filter(pa.array([not x for x in spans], pa.bool_()))
                for i in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(i, OUT_ROWS)

    return run


def _blocks(items: DataFrame, phrase_bytes: int, length: int):
    """Lists of (item_id, text) of at most phrase_bytes each, one after the other. Items of many words are cut into pieces that overlap by length - 1 words, so that each window lies in one; the rest is dealt by a hash of
    id and text, into more blocks until none is too large."""
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    step = max(length, min(PIECE_WORDS, phrase_bytes // 256))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (length - 1), F.lit(1)), F.lit(step))
    long = items.where(F.octet_length("text") > 64 * step).withColumn("_words", words).withColumn("_at", F.explode(starts)).select("item_id", F.array_join(F.slice("_words", F.col("_at"), F.lit(step + length - 1)), " ").alias("text"))
    items = items.where(F.octet_length("text") <= 64 * step).union(long)
    weight = F.octet_length("text") + F.octet_length("item_id") + 64
    size, most = items.agg(F.sum(weight), F.max(weight)).first()
    if (most or 0) > phrase_bytes:
        raise ValueError(f"a piece of {step + length - 1} words takes {most} bytes, more than phrase_bytes")
    blocks = max(1, -(-(size or 0) // phrase_bytes))
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while blocks > 1 and items.distinct().groupBy(block(blocks).alias("block")).agg(F.sum(weight).alias("size")).agg(F.max("size")).first()[0] > phrase_bytes:
        blocks *= 2
    for b in range(blocks):
        yield b + 1 == blocks, [tuple(r) for r in (items.distinct().where(block(blocks) == b) if blocks > 1 else items).collect()]


def _searched(docs: DataFrame, benchmark: DataFrame, length: int, text: str, item_id: str, phrase_bytes: int, keep: list[str], clean_only: bool) -> DataFrame:
    """The columns `keep` as _0 and so on, with n_words, spans and items; with clean_only, only rows without spans."""
    set_up(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), text_of(text).alias("text"))
    every = [text, *(c for c in keep if c != text)]  # a text that is kept goes to Python and back once
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_0"), *numbered(docs, every)[0][1:])
    for place, (last, block) in enumerate(_blocks(items, phrase_bytes, length)):
        table, out = sc.broadcast(phrase_table(block, length)), keep if last else every
        found = rows.mapInArrow(released(_search(table, [every.index(c) for c in out], place > 0, clean_only)), with_fields(numbered(docs, out)[1], OUT))
        if not last:  # the tables of several passes don't meet in one task
            found = written(found, "contamination")
            rows = found.drop("n_words")
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", phrase_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged [start, end) in words), items.

    Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z in lower case. A window is `length` consecutive words of an item; an item of fewer words, but not none, is one
    window. A word of a text inside any occurrence of a window is hit. Null or empty texts have no words; an empty benchmark, or one without words, hits nothing; a null
    item_id counts as ''; items of the same id count as one. Repeated rows give a row each. With more than phrase_bytes of benchmark text the items are dealt into blocks, none larger than that, searched block
    by block, and merged as the row goes by.
    """
    found = _searched(docs, benchmark, length, text, item_id, phrase_bytes, [doc_id], False)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        F.col("_0").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        F.array_sort("items").alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, text: str = "text", item_id: str = "item_id", phrase_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns, whatever their names. A row is judged by its own text alone, so null and repeated ids don't matter, and nothing is shuffled;
    null and empty texts stay; edge cases of items are as in contamination()."""
    found = _searched(docs, benchmark, length, text, item_id, phrase_bytes, docs.columns, True)
    return found.select(renamed(found, docs.columns))

"""Alignment of two tokenizers' tokens: DuckDB within each Arrow partition, merging in Spark.

1. A text is parted where tokens of both tokenizers surely end: before a space or line end that follows, and is followed by, something else. What stands between two such places (a unit: mostly a word with its marks) gives the same tokens, groups and links wherever it
   stands, so a task encodes and aligns each different unit of a chunk once. A text with other white space, or that isn't given back, is encoded whole, and its spans are units of their own. Tokens become byte intervals; about PIECE bytes of units lie one after the other on one axis, so an interval table of either tokenizer holds them all.
2. DuckDB aligns a piece: an ASOF join finds the B token that ends last at or before the end of each A token, which tells where both end; a window sum of these cuts numbers the groups; an ASOF join puts each B token into
   its group. Where an A and a B token cover the same bytes they are the group's link; in wider groups a range join finds the B tokens within the bytes of an A token's group. Links are counted by unit and id pair.
3. Over a chunk of CHUNK bytes, units' links are summed for each document, and pairs are counted by document: partial counts, which Spark merges. The document rows keep places in their chunk's list of pairs.
4. Counts, and whether a count is its A id's highest (one number for each id of the vocabulary), go back to each chunk's list, once for each chunk and pair, and there to the documents. No pair is sent for each document, and the more chunks share a pair, the
   more tasks its rows come from; a chunk is all that ever meets in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import tokens as T
from fathomline.llm.shared import held, numbered, parts, released, renamed, set_up, with_fields, written

#: Bytes of text that DuckDB aligns at once, and that share one list of pairs (one text at least).
PIECE, CHUNK = 1 << 20, 12 << 20
#: Pairs in one row of a chunk's list.
SLICE = 1000
#: Documents in one batch of rows, and the longest unit in characters.
ROWS, LONGEST = 500, 1000
#: Fixed value: where byte-level BPE parts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a run that tiktoken merges fast.
RUN = 2000
BLANKS = re.compile(rf"\s{{{RUN}}}")


class Pair:
    """Both tokenizers, with the bytes and texts of their ids. A's ids come from tiktoken, with the ranks that A's file says, and from the tokenizers library for texts with a very long run without (or of) white space, in which tiktoken's time grows with the square."""

    def __init__(self, content_a: str, content_b: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.slow = T.Encoder(content_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=content_b)
        letters = {letter: byte for byte, letter in T.byte_letters().items()}
        described = json.loads(content_a)
        ranks = {bytes(letters[c] for c in entry): i for entry, i in described["model"]["vocab"].items()}
        special = {x["content"] for x in described["added_tokens"]}
        ranks = {entry: i for entry, i in ranks.items() if entry.decode("utf-8", "ignore") not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.bytes_a[i] = entry
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int32) for own in (self.bytes_a, self.bytes_b))
        #: Whether B's tokens end before each space and line end that follows something else.
        self.parts_alone = not any(re.search("[^\u2581]\u2581|\n", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.said = {sep: np.array([f"{sep}{i}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object) for sep in ",;|"}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if max(map(len, text.split()), default=0) >= RUN or BLANKS.search(text):
            return np.frombuffer(self.slow.encode([text], 0)[0], "<u4")[:-1].tolist()
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if the text is empty or one of them doesn't give its bytes back."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.encode_a(" " + text), self.b.encode(text, num_threads=1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        return (np.array(a, np.int32), np.array(b, np.int32)) if same else None


_LOADED = held()


def pair_of(content_a: str, content_b: bytes) -> Pair:
    """One for each Python worker."""
    key = hash((content_a, content_b))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(content_a, content_b)
    return _LOADED[key]


ALIGN = [
    """create or replace temp table grouped_a as
        select seq, span, id, start, stop, other, cast(coalesce(sum(cast(cut as int)) over (order by seq rows between unbounded preceding and 1 preceding), 0) as int) as grp
        from (select a.*, coalesce(b.stop = a.stop, false) as cut, case when b.stop = a.stop and b.start = a.start then b.id end as other from tokens_a a asof left join tokens_b b on a.stop >= b.stop)""",
    "create or replace temp table grouped as select grp, min(start) as lo, max(stop) as hi from grouped_a group by grp",
    "create or replace temp table grouped_b as select b.*, g.grp from tokens_b b asof join grouped g on b.start >= g.lo",
    "create or replace temp table wide as select grp, lo, hi from grouped semi join (select grp from grouped_a where other is null) using (grp)",
]
LINKS = """with rest_a as (select span, id, lo, hi from grouped_a join wide using (grp)), rest_b as (select id, start, stop from grouped_b semi join wide using (grp)),
    links as (select span, (cast(id as bigint) << 32) | other as pair from grouped_a where other is not null
        union all select a.span, (cast(a.id as bigint) << 32) | b.id from rest_a a join rest_b b on b.start >= a.lo and b.stop <= a.hi)
    select span, pair, count(*) as n from links group by all order by all"""


def align(con, pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, dict, list[str]]:
    """Of spans (n_a ids of A and n_b ids of B with equal bytes, in which the last tokens of both end), whose ids follow each other in a and b: (groups of each, links {span, pair, n} by span and pair, the groups of each as text, every group with ; before it)."""
    stop_a, stop_b = np.cumsum(pair.size_a[a], dtype=np.int32), np.cumsum(pair.size_b[b], dtype=np.int32)
    number = lambda n: np.arange(n, dtype=np.int32)
    con.register("tokens_a", pa.table({"seq": number(len(a)), "span": np.repeat(number(len(n_a)), n_a), "id": a, "start": stop_a - pair.size_a[a], "stop": stop_a}))
    con.register("tokens_b", pa.table({"seq": number(len(b)), "id": b, "start": stop_b - pair.size_b[b], "stop": stop_b}))
    for step in ALIGN:
        con.execute(step)
    group_a, group_b = (np.empty(len(x), np.int64) for x in (a, b))
    for group, name in ((group_a, "grouped_a"), (group_b, "grouped_b")):
        found = con.execute(f"select seq, grp from {name}").fetchnumpy()
        group[found["seq"]] = found["grp"]
    links = con.execute(LINKS).fetchnumpy()
    # A's ids of a group stand before B's
    last_a, last_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    said = np.empty(len(a) + len(b), object)
    first_a, first_b = (np.concatenate([[True], g[1:] != g[:-1]]) for g in (group_a, group_b))
    said[np.arange(len(a)) + np.concatenate([[0], last_b[:-1]])[group_a]] = np.where(first_a, pair.said[";"][a], pair.said[","][a])
    said[np.arange(len(b)) + last_a[group_b]] = np.where(first_b, pair.said["|"][b], pair.said[","][b])
    cuts, groups = np.cumsum(n_a + n_b), np.add.reduceat(first_a.astype(np.int64), np.cumsum(n_a) - n_a)
    return groups, links, ["".join(said[at:to].tolist()) for at, to in zip([0, *cuts[:-1]], cuts, strict=True)]


def parted(pair: Pair, a: np.ndarray, b: np.ndarray, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A text's ids in spans of at most about `most` bytes, cut where tokens of both end; a single group stays whole."""
    stop_a, stop_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    if stop_a[-1] <= most:
        yield a, b
        return
    both = np.intersect1d(stop_a, stop_b, assume_unique=True)
    at = at_a = at_b = 0
    while at < stop_a[-1]:
        place = int(np.searchsorted(both, at + most, "right")) - 1
        to = both[place] if place >= 0 and both[place] > at else both[place + 1]
        to_a, to_b = int(np.searchsorted(stop_a, to)) + 1, int(np.searchsorted(stop_b, to)) + 1
        yield a[at_a:to_a], b[at_b:to_b]
        at, at_a, at_b = int(to), to_a, to_b


class Units(dict):
    """Numbers of what stands between two places where a text is parted, without the space before it (a line end stays). new: those that aren't encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, part: str) -> int:
        own = part[1:] if part[:1] == "\n" else part
        if not own or own[0].isspace() or own[-1].isspace() or len(part) > LONGEST or "\u2581" in part:
            raise T.Uneven
        self.new.append(part)
        self[part] = at = self.next
        self.next += 1
        return at

    def forget(self) -> None:
        """Takes the new ones back."""
        for part in self.new:
            del self[part]
        self.next -= len(self.new)
        self.new = []


class Chunk:
    """Documents of a chunk as numbers of units, and what each unit holds. A text that is encoded whole has units of its own."""

    def __init__(self, con, pair: Pair) -> None:
        self.con, self.pair, self.table = con, pair, Units()
        self.rows: list[tuple] = []
        self.units: list[np.ndarray] = []  # of each document
        self.digests: list = []  # of documents with units of their own
        self.sizes: list[np.ndarray] = [np.zeros((0, len(SIZES)), np.int64)]  # of each unit
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]  # how many different pairs each unit has; pairs, and how often
        self.said: list[bytes] = []
        self.waiting: list[tuple] = []
        self.bytes = self.pending = 0

    def add(self, row: tuple, text: str) -> None:
        numbers, doc = self.shared(text), len(self.rows)
        self.rows.append(row)
        self.digests.append(None)
        if numbers is None:
            ids, numbers = self.pair.encode(text), []
            for a, b in parted(self.pair, *ids) if ids else ():
                numbers.append(self.table.next)
                self.table.next += 1
                self.wait(doc, a, b, np.array([len(a)]), np.array([len(b)]))
        self.units.append(np.array(numbers, np.int32))
        self.bytes += len(text.encode())

    def shared(self, text: str) -> list[int] | None:
        """Numbers of the text's units; None if it must be encoded whole."""
        if not self.pair.parts_alone:
            return None
        try:
            numbers = list(map(self.table.__getitem__, text.replace("\n", " \n").split(" ")))
        except T.Uneven:
            self.table.forget()
            return None
        if self.table.new:
            parts = [part if part[0] == "\n" else " " + part for part in self.table.new]
            ids = self.pair.encode("." + "".join(parts))  # with a unit before them, so that the first may begin with a line end
            ends = np.cumsum([2, *(len(part.encode()) for part in parts)])
            at = [np.searchsorted(np.cumsum(size[own]), ends) for size, own in zip((self.pair.size_a, self.pair.size_b), ids, strict=True)] if ids else []
            if not ids or any((np.cumsum(size[own])[x] != ends).any() for size, own, x in zip((self.pair.size_a, self.pair.size_b), ids, at, strict=True)):
                self.table.forget()
                return None
            self.wait(None, *(own[x[0] + 1 :] for own, x in zip(ids, at, strict=True)), *map(np.diff, at))
            self.table.new = []
        return numbers

    def wait(self, doc: int | None, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        size = int(self.pair.size_a[a].sum())
        if self.waiting and self.pending + size > PIECE:
            self.flush()
        self.waiting.append((doc, a, b, n_a, n_b))
        self.pending += size

    def flush(self) -> None:
        if not self.waiting:
            return
        a, b, n_a, n_b = (np.concatenate([w[i] for w in self.waiting]) for i in range(1, 5))
        groups, links, said = align(self.con, self.pair, a, b, n_a, n_b)
        different = np.bincount(links["span"], minlength=len(n_a))
        self.links.append((different, links["pair"], links["n"].astype(np.int64)))
        self.sizes.append(np.stack([n_a, n_b, groups, np.bincount(links["span"], links["n"], len(n_a)).astype(np.int64)], 1))
        at = 0
        for doc, *_, n in self.waiting:
            own = said[at : at + len(n)]
            at += len(n)
            if doc is None:
                self.said += [x.encode() for x in own]
            elif self.digests[doc]:
                self.digests[doc].update(own[0].encode())
            else:
                self.digests[doc] = hashlib.sha256(own[0][1:].encode())
            if doc is not None:
                self.said.append(b"")
        self.waiting, self.pending = [], 0

    def digest(self, doc: int) -> str:
        out, units = self.digests[doc], self.units[doc]
        if out is None:
            out = hashlib.sha256()
            for at in range(0, len(units), 100_000):
                own = b"".join(map(self.said.__getitem__, units[at : at + 100_000].tolist()))
                out.update(own if at else own[1:])
        return out.hexdigest() if len(units) else ""

    def batches(self, number: int, kept: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.flush()
        self.table.clear()  # its texts aren't needed any more
        sizes, (different, pairs, times) = np.concatenate(self.sizes), (np.concatenate(x) for x in zip(*self.links, strict=True))
        self.sizes, self.links = [], []
        begins = np.cumsum(different) - different
        every = np.unique(pairs)
        place = np.searchsorted(every, pairs).astype(np.int32)
        del pairs
        count = np.zeros(len(every), np.int64)
        for at in range(0, len(self.rows), ROWS):
            n = min(ROWS, len(self.rows) - at)
            to, units = at + n, np.concatenate(self.units[at : at + n])
            doc = np.repeat(np.arange(n), [len(x) for x in self.units[at:to]])
            total = [np.bincount(doc, sizes[units, i], n).astype(np.int64) for i in range(len(SIZES))]
            keys, often = np.unique(doc << 32 | units, return_counts=True)  # each different unit of a document once
            units, size = keys & 0xFFFFFFFF, different[keys & 0xFFFFFFFF]
            links = np.repeat(begins[units] - np.cumsum(size) + size, size) + np.arange(size.sum())
            keys, often = np.repeat(keys >> 32 << 32, size) | place[links], np.repeat(often, size) * times[links]
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            keys, often = keys[first], np.add.reduceat(often[order], first) if len(first) else often
            cuts, places = np.searchsorted(keys >> 32, np.arange(n + 1)).astype(np.int32), keys & 0xFFFFFFFF
            count += np.bincount(places, minlength=len(every))
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (places.astype(np.int32), often)]
            own = [pa.array([r[i] for r in self.rows[at:to]], kept.field(i).type) for i in range(len(kept))]
            sha = pa.array([self.digest(i) for i in range(at, to)])
            yield _batch(kept, number, n, {**{f"_{i}": c for i, c in enumerate(own)}, **{name: pa.array(c) for name, c in zip(SIZES, total, strict=True)}, "groups_sha256": sha, "places": lists[0], "times": lists[1]}, 1, np.zeros(n, np.int32))
        for at in range(0, len(every), SLICE * 100):
            here, n = every[at : at + SLICE * 100], count[at : at + SLICE * 100]
            starts = np.append(np.arange(0, len(here), SLICE), len(here)).astype(np.int32)
            lists = {name: pa.ListArray.from_arrays(pa.array(starts), pa.array(v)) for name, v in (("pairs", here), ("docs", n))}
            yield _batch(kept, number, len(starts) - 1, lists, 0, np.arange(at // SLICE, at // SLICE + len(starts) - 1, dtype=np.int32))


SIZES = ["n_a", "n_b", "n_groups", "n_links"]
DDL = "chunk bigint, kind int, slice int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places array<int>, times array<bigint>, pairs array<bigint>, docs array<bigint>"
ARROW = [*[(n, pa.int64()) for n in SIZES], ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]


def _batch(kept: pa.Schema, number: int, n: int, columns: dict, kind: int, slices: np.ndarray) -> pa.RecordBatch:
    fields = [*kept, pa.field("chunk", pa.int64()), pa.field("kind", pa.int32()), pa.field("slice", pa.int32()), *(pa.field(name, t) for name, t in ARROW)]
    always = {"chunk": pa.array(np.full(n, number)), "kind": pa.array(np.full(n, kind, np.int32)), "slice": pa.array(slices)}
    return pa.RecordBatch.from_arrays([always.get(f.name, columns.get(f.name, pa.nulls(n, f.type))) for f in fields], schema=pa.schema(fields))


def _aligned(contents_at):
    def run(batches):
        import duckdb

        pair = pair_of(*contents_at.value)
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            number, chunk, kept = TaskContext.get().partitionId() << 32, None, None
            for batch in batches:
                kept = pa.schema([batch.schema.field(i) for i in range(1, batch.num_columns)])
                columns = [batch.column(i) for i in range(1, batch.num_columns)]
                for i in range(batch.num_rows):
                    if chunk is None:
                        chunk = Chunk(con, pair)
                    chunk.add(tuple(c[i].as_py() for c in columns), batch.column(0)[i].as_py() or "")
                    if chunk.bytes >= CHUNK:
                        yield from chunk.batches(number, kept)
                        chunk, number = None, number + 1
            if chunk:
                yield from chunk.batches(number, kept)

    return run


def _looked_up(n_kept: int):
    """Of rows by chunk, its list of values (kind 0) before its documents (kind 1): each document with n_best and count_sum."""

    def run(batches):
        last, lists, values = None, [], None
        for batch in batches:
            chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            border = np.concatenate([[0], np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(chunk)]]) if len(chunk) else np.zeros(1, int)
            for at, to in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                if chunk[at] != last:
                    last, lists, values = chunk[at], [], None
                own = batch.slice(at, to - at)
                if kind[at] == 0:
                    lists.append(np.asarray(own.column("values").flatten()))
                    continue
                if values is None:
                    values, lists = np.concatenate([np.zeros(0, np.int64), *lists]), []
                size = np.asarray(own.column("places").value_lengths()).astype(np.int64)
                value, times = values[np.asarray(own.column("places").flatten())], np.asarray(own.column("times").flatten())
                doc = np.repeat(np.arange(len(size)), size)
                totals = np.zeros((2, len(size)), np.int64)
                np.add.at(totals[0], doc, times * (value & 1))
                np.add.at(totals[1], doc, times * (value >> 1))
                out = [*(own.column(f"_{i}") for i in range(n_kept)), *(own.column(n) for n in SIZES), pa.array(totals[0]), pa.array(totals[1]), own.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(out, [*(f"_{i}" for i in range(n_kept)), *SIZES, "n_best", "count_sum", "groups_sha256"])

    return run


def load(path_a: str, path_b: str) -> tuple[str, bytes]:
    """The contents of both tokenizers' files, to be broadcast: executors need not have them."""
    with open(path_b, "rb") as file:
        return T.load(path_a), file.read()


def alignments(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame, int]:
    """(aligned documents and partial pair counts by chunk, counts (pair, n) over all documents, number of kept columns); pair is A's id * 2**32 + B's id."""
    set_up(docs.sparkSession)
    contents_at = docs.sparkSession.sparkContext.broadcast(load(path_a, path_b))
    own, fields = numbered(docs, keep)
    each = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), *own).mapInArrow(released(_aligned(contents_at), keeps=True), with_fields(fields, DDL))
    each = written(each, "align-documents")
    partial = each.where("kind = 0").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    return each, written(partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")), "align-counts"), len(fields)


def link_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the columns `keep`, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair's count is the highest of its A id), count_sum (over links), groups_sha256.

    Tokenizer A (a tokenizers file of byte-level BPE) encodes a space and the text, B (a sentencepiece model) the text, to which it adds that space. Groups lie between byte offsets where tokens of both end; links are all pairs of an A and a B token of one group; a pair's count is the number of rows
    that hold it linked. A null or empty text, or one whose bytes either tokenizer doesn't give back, has no tokens: zeros and an empty digest. Repeated rows count and come back as often as they are there; an empty table gives an empty one;
    other columns aren't read. A text of any length is aligned in spans that end where both tokenizers' tokens do; only a chunk's list of pairs and its documents' places in it meet in one task.
    """
    each, counts, n_kept = alignments(docs, path_a, path_b, text, keep)
    fields = each.schema.fields[:n_kept]
    a = F.shiftright("pair", 32).cast("int").alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))  # one row for each id of A's vocabulary at most
    valued = counts.select("pair", "n", a).join(F.broadcast(top), "a").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("top")).cast("bigint")).alias("value"))
    asked = each.where("kind = 0").select("chunk", "slice", F.posexplode("pairs").alias("place", "pair"))
    answered = asked.join(valued, "pair").groupBy("chunk", "slice").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("found"))
    kept = [f"_{i}" for i in range(n_kept)]
    columns = [*kept, *SIZES, "groups_sha256", "places", "times"]
    lists = answered.select("chunk", F.lit(0).alias("kind"), "slice", F.transform("found", lambda f: f["value"]).alias("values"), *(F.lit(None).cast(each.schema[c].dataType).alias(c) for c in columns))
    both = lists.unionByName(each.where("kind = 1").select("chunk", "kind", "slice", F.lit(None).cast("array<bigint>").alias("values"), *columns))
    both = both.repartition(parts(docs), "chunk").sortWithinPartitions("chunk", "kind", "slice")
    found = both.mapInArrow(released(_looked_up(n_kept)), with_fields(fields, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"))
    return found.select(*renamed(found, keep), *SIZES, "n_best", "count_sum", "groups_sha256")

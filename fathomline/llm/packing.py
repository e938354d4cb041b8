"""Packing of documents into training sequences by bounded-space online best fit.

A task holds at most OPEN unfinished windows. A document's whole windows go out as they are; what is left goes into the open window with the least room that takes it. If none
does and no more may be opened, the fullest window is filled up with a cut of the document and emitted. At the end of a task the open windows are merged into full ones, and less than
one window is left over. Leftovers of GROUP tasks each are merged likewise; the last tokens of such a group are cut into windows whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import tokens
from fathomline.llm.shared import parts, released, set_up, text_of, written

LENGTH = 2048
OPEN = 32
GROUP = 64
#: Leftover windows are numbered from here; those of a task from its number times 2**36.
MERGED = 1 << 62


class Packer:
    """emit(pieces): called with each finished window, a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, emit, length: int = LENGTH, most_open: int = OPEN) -> None:
        self.emit, self.length, self.most = emit, length, most_open
        self.open: list[list] = []  # [tokens, pieces]

    def add(self, doc_id, ids: bytes, start: int = 0, doc_tokens: int | None = None) -> None:
        n = len(ids) // 4
        doc_tokens = n if doc_tokens is None else doc_tokens
        at = 0
        while n - at >= self.length:
            self.emit([(doc_id, start + at, ids[4 * at : 4 * (at + self.length)], doc_tokens)])
            at += self.length
        while at < n:
            rest = n - at
            fits = [w for w in self.open if self.length - w[0] >= rest]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
            take = min(rest, self.length - window[0])
            window[1].append((doc_id, start + at, ids[4 * at : 4 * (at + take)], doc_tokens))
            window[0] += take
            at += take
            if window[0] == self.length:
                self.emit(window[1])
                self.open.remove(window)

    def finish(self) -> list[tuple]:
        """Merges the open windows, the fullest first; returns the pieces that are left, fewer tokens than a window."""
        windows, self.open, self.most = sorted(self.open, key=lambda w: -w[0]), [], 1
        for _, pieces in windows:
            for doc_id, start, ids, doc_tokens in pieces:
                self.add(doc_id, ids, start, doc_tokens)
        return self.open[0][1] if self.open else []


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "part", "ids"]


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.int64()] * 8, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FIELDS)


class Rows:
    """Rows of finished windows, numbered from `first`."""

    def __init__(self, first: int, part: int, with_ids: bool) -> None:
        self.next, self.part, self.with_ids, self.rows = first, part, with_ids, []

    def window(self, pieces: list[tuple], padded: int = LENGTH) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next, offset, padded, self.part, ids if self.with_ids else None))
            offset += n
        self.next += 1


def _pack(content_at, end: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = Rows(part << 36, part, with_ids)
        packer, kind = Packer(rows.window), pa.int64()
        for batch, at, to, ids in tokens.encoded(batches, content_at, end):
            kind = batch.schema.field(1).type
            for doc_id, own in zip(batch.column(1).slice(at, to - at).to_pylist(), ids, strict=True):
                packer.add(doc_id, own)
            if rows.rows:
                yield _batch(rows.rows, kind)
                rows.rows = []
        left = packer.finish()
        rows.rows += [(doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, -1, 0, 0, part, ids) for doc_id, start, ids, doc_tokens in left]
        if rows.rows:
            yield _batch(rows.rows, kind)

    return run


def _merge(with_ids: bool):
    def run(batches):
        held, kind = {}, pa.int64()
        for batch in batches:  # the leftovers of at most GROUP tasks a group: GROUP * LENGTH tokens
            kind = batch.schema.field(0).type
            for row in batch.to_pylist():
                held.setdefault(row["part"] // GROUP, []).append(row)
        for group, own in sorted(held.items()):
            rows = Rows(MERGED + (group << 36), group * GROUP, with_ids)
            packer = Packer(rows.window, most_open=1)
            own.sort(key=lambda r: (r["part"], str(r["doc_id"]), r["start"], r["ids_crc32"]))
            for r in own:
                packer.add(r["doc_id"], r["ids"], r["start"], r["doc_tokens"])
            left = packer.finish()
            while left:  # lengths that are powers of two, the largest first
                size = 1 << (sum(len(p[2]) // 4 for p in left).bit_length() - 1)
                part, room = [], size
                while room:
                    doc_id, start, ids, doc_tokens = left.pop(0)
                    n = min(room, len(ids) // 4)
                    part.append((doc_id, start, ids[: 4 * n], doc_tokens))
                    if 4 * n < len(ids):
                        left.insert(0, (doc_id, start + n, ids[4 * n :], doc_tokens))
                    room -= n
                rows.window(part, size)
            yield _batch(rows.rows, kind)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end: int, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, padded_length, and ids with with_ids.

    A document's ids end with `end`. Null and empty texts are that id alone. A sequence's pieces lie at offsets without gaps from 0; it has LENGTH tokens or, among the merged leftovers,
    a power of two, so nothing is padded. Rows that repeat a doc_id are documents of their own. An empty table gives an empty one. Other columns aren't read.
    """
    set_up(docs.sparkSession)
    content_at = docs.sparkSession.sparkContext.broadcast(tokens.load(tokenizer_path))
    rows = docs.select(text_of(text).alias("text"), F.col(doc_id).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint, part bigint, ids binary"
    packed = written(rows.mapInArrow(released(_pack(content_at, end, with_ids), keeps=True), schema), "packed")
    left = packed.where("sequence_id < 0").withColumn("_group", F.floor(F.col("part") / GROUP)).repartition(parts(docs), "_group").drop("_group")
    every = packed.where("sequence_id >= 0").union(left.mapInArrow(released(_merge(with_ids)), schema))
    return every.drop("part") if with_ids else every.drop("part", "ids")

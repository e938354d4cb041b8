"""Exact deduplication by Grace hashing: records are partitioned by hash until each bucket fits an open-addressing table that compares complete texts.

1. A task reads its input in chunks and keeps one record for each different text of a chunk, with the number of records it stands for: a group of
   copies, whatever its size, sends a record for each chunk at most through the shuffle.
2. Spark deals these records out by a hash of the text. A task whose share is larger than its memory budget partitions it, by other bits of the
   hash, into spill files (unnamed, gone with the task, as Spark's own spills), and each of those again, until a bucket fits.
3. Each bucket goes through the table, which compares hashes first and then the complete texts.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import parts, released, set_up, text_of

BUDGET = 32 << 20
FANOUT = 16


def normalised(text: Column) -> Column:
    """Null as empty; each run of \\x20 and \\x09-\\x0D as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Table:
    """Open addressing with linear probing: slots hold the places of entries; equal hashes are settled by the complete texts."""

    def __init__(self, n: int) -> None:
        self.mask = (1 << max(4, (2 * n).bit_length())) - 1
        self.slots = [-1] * (self.mask + 1)
        self.hashes: list[int] = []
        self.texts: list = []

    def place(self, h: int, text) -> int:
        """The entry of this text, a new one if there's none."""
        slot = h & self.mask
        while (at := self.slots[slot]) >= 0:
            if self.hashes[at] == h and self.texts[at] == text:
                return at
            slot = (slot + 1) & self.mask
        self.slots[slot] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        return len(self.texts) - 1


def _reduced(table: pa.Table) -> pa.Table:
    """One row for each different text: that of the smallest (id, order), with the counts of all. Columns: _hash, _norm, _id, _copies, then others."""
    n = len(table)
    hashes, ids, copies = (table.column(i).to_numpy() for i in (0, 2, 3))
    if n < 2 or len(np.unique(hashes)) == n:
        return table
    norm = table.column(1).combine_chunks()
    found = Table(n)
    entry = np.fromiter((found.place(h, norm[i]) for i, h in enumerate(hashes.tolist())), np.int64, n)
    order = np.lexsort((np.arange(n), ids, entry))
    first = np.ones(n, bool)
    first[1:] = entry[order][1:] != entry[order][:-1]
    total = np.add.reduceat(copies[order], np.flatnonzero(first))
    return table.take(pa.array(order[first])).set_column(3, table.schema.field(3), pa.array(total))


def _chunks(batches):
    """Tables of about BUDGET bytes."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, step := max(1, int(batch.num_rows * BUDGET / max(batch.nbytes, 1)))):
            held.append(batch.slice(at, step))
            size += batch.nbytes * min(step, batch.num_rows - at) // max(batch.num_rows, 1)
            if size >= BUDGET:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _combine(batches):
    for table in _chunks(batches):
        yield from _reduced(table).to_batches(max_chunksize=10_000)


class Spill:
    """A bucket's records in an unnamed file that ends with the task."""

    def __init__(self, schema: pa.Schema) -> None:
        self.file = tempfile.TemporaryFile()
        self.writer = pa.ipc.new_stream(self.file, schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
        self.bytes = 0

    def add(self, table: pa.Table) -> None:
        self.writer.write_table(table)
        self.bytes += table.nbytes

    def read(self):
        self.writer.close()
        self.file.seek(0)
        yield from pa.ipc.open_stream(self.file)
        self.file.close()


def _grace(tables, depth: int = 0):
    """Reduced tables of a stream of any size, in memory of about BUDGET. Chunks are reduced as they come; what outgrows the budget is dealt to spill files."""
    held: list[pa.Table] = []
    size, files = 0, None
    for table in tables:
        table = _reduced(table)
        if files is None and size + table.nbytes > BUDGET and held:
            table = _reduced(pa.concat_tables([*held, table]))
            held, size = [], 0
            if table.nbytes > BUDGET and depth < 12:
                files = [Spill(table.schema) for _ in range(FANOUT)]
        if files is None:
            held.append(table)
            size += table.nbytes
            continue
        bucket = (table.column(0).to_numpy().view(np.uint64) >> np.uint64(4 * depth + 16)).astype(np.int64) & (FANOUT - 1)
        for b in np.unique(bucket):
            files[b].add(table.filter(pa.array(bucket == b)))
    if files is None:
        if held:
            yield _reduced(pa.concat_tables(held))
        return
    for spill in files:
        yield from _grace((t for t in _chunks(spill.read())), depth + 1)


def _dedup(batches):
    for table in _grace(_chunks(batches)):
        yield from table.to_batches(max_chunksize=10_000)


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = True) -> DataFrame:
    """One row for each different text: _hash, _norm, _id (smallest doc_id), _copies (rows of that text) and, with carry, the columns of that row.

    Texts are equal when identical after normalised(). Of rows with the same smallest doc_id and text, one (any) stays. Null doc_ids come after all others.
    Extra columns pass through under names of their own, so names like _hash don't clash.
    """
    set_up(docs.sparkSession)
    norm = normalised(F.col(text))
    own = [F.xxhash64(norm).alias("_hash"), norm.alias("_norm"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(2**63 - 1)).alias("_id"), F.lit(1).cast("bigint").alias("_copies")]
    rows = docs.select(*own, *((F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)) if carry else ()))
    few = rows.mapInArrow(released(_combine), rows.schema)
    return few.repartition(parts(docs), "_hash").mapInArrow(released(_dedup), rows.schema)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. A null text counts as empty; an empty table stays empty."""
    return distinct_texts(docs, doc_id, text).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row of the smallest doc_id stays; of rows that repeat both, one stays and the others have kept false. Null texts equal empty
    ones. Null doc_ids come after all others: a group of nothing else has a null keep_id. Further columns aren't read.
    """
    sha = F.sha2(normalised(F.col(text)), 256)
    # rows that repeat a doc_id and its text are counted before any shuffle and given back at the end
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), sha.alias("text_sha256")).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    stay = distinct_texts(docs, doc_id, text, carry=False).select(F.sha2("_norm", 256).alias("text_sha256"), F.nullif(F.col("_id"), F.lit(2**63 - 1)).alias("keep_id"), F.col("_copies").alias("group_size"))
    return rows.join(stay, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.explode(F.when(F.col("times") == 1, F.array(F.lit(1).cast("bigint"))).otherwise(F.sequence(F.lit(1).cast("bigint"), "times"))).alias("time"), "text_sha256"
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "text_sha256")

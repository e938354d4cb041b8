"""Token ids in binary files of independent zstandard frames, a seek table at the end.

A file holds documents of ascending doc_id. Layout, all integers little-endian:

    8 bytes   MAGIC
    frames    each a zstandard frame of one document's unsigned 32-bit ids (a long document has several, of FRAME_IDS ids)
    table     a zstandard frame of DOCUMENT records (doc_id, frames, ids) and then FRAME records (compressed bytes, ids, crc32 of the ids' bytes)
    footer    FOOTER: number of documents, number of frames, bytes of the table, crc32 of the table, MAGIC

A reader reads the footer and the table, and then those frames only that hold the documents it wants; frames need nothing from each other.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import tokens
from fathomline.llm.shared import new_path, parts, released, set_up, text_of

MAGIC = b"FLTOKEN1"
FRAME_IDS = 1 << 16
#: What a null doc_id is written as; such documents come first.
NO_ID = -(2**63)
DOCUMENT = np.dtype([("doc_id", "<i8"), ("frames", "<u4"), ("ids", "<u8")])
FRAME = np.dtype([("bytes", "<u4"), ("ids", "<u4"), ("crc32", "<u4")])
FOOTER = np.dtype([("documents", "<u8"), ("frames", "<u8"), ("table_bytes", "<u8"), ("table_crc32", "<u4"), ("magic", "S8")])


class Writer:
    """Writes under a name of its own and takes the final name when all is written: a task that is lost or runs twice leaves one whole file."""

    def __init__(self, uri: str, level: int = 3) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.documents: list[tuple] = []
        self.frames: list[tuple] = []
        self.ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        n = 0
        for at in range(0, len(ids), 4 * FRAME_IDS):
            part = ids[at : at + 4 * FRAME_IDS]
            packed = self.press.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part) // 4, zlib.crc32(part)))
            n += 1
        self.documents.append((doc_id, n, len(ids) // 4))
        self.ids += len(ids) // 4

    def close(self) -> None:
        table = self.press.compress(np.array(self.documents, DOCUMENT).tobytes() + np.array(self.frames, FRAME).tobytes())
        self.out.write(table)
        self.out.write(np.array([(len(self.documents), len(self.frames), len(table), zlib.crc32(table), MAGIC)], FOOTER).tobytes())
        self.out.close()
        self.fs.move(self.own, self.path)


class Reader:
    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        footer = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if footer["magic"] != MAGIC:
            raise ValueError(f"{uri} isn't a token file, or isn't whole")
        n, at = int(footer["table_bytes"]), size - FOOTER.itemsize
        table = self.file.read_at(n, at - n)
        if zlib.crc32(table) != footer["table_crc32"]:
            raise ValueError(f"{uri}: the seek table is damaged")
        self.unpack = zstandard.ZstdDecompressor()
        table = self.unpack.decompress(table, max_output_size=int(footer["documents"]) * DOCUMENT.itemsize + int(footer["frames"]) * FRAME.itemsize)
        cut = int(footer["documents"]) * DOCUMENT.itemsize
        self.documents, self.frames = np.frombuffer(table[:cut], DOCUMENT), np.frombuffer(table[cut:], FRAME)
        self.frame_at = len(MAGIC) + np.concatenate([[0], np.cumsum(self.frames["bytes"].astype(np.int64))])
        self.first = np.concatenate([[0], np.cumsum(self.documents["frames"].astype(np.int64))])
        self.start = np.concatenate([[0], np.cumsum(self.documents["ids"].astype(np.int64))])

    def ids(self, number: int) -> bytes:
        """The ids of the document at this place in the file; no other document's frames are read."""
        at, to = int(self.first[number]), int(self.first[number + 1])
        raw = self.file.read_at(int(self.frame_at[to] - self.frame_at[at]), int(self.frame_at[at]))
        out = []
        for f in range(at, to):
            here = int(self.frame_at[f] - self.frame_at[at])
            part = self.unpack.decompress(raw[here : here + int(self.frames["bytes"][f])], max_output_size=4 * int(self.frames["ids"][f]))
            if zlib.crc32(part) != self.frames["crc32"][f]:
                raise ValueError(f"frame {f} is damaged")
            out.append(part)
        return b"".join(out)

    def find(self, doc_id: int) -> range:
        """Places of the documents of this id (more than one if rows repeat)."""
        return range(*np.searchsorted(self.documents["doc_id"], [doc_id, doc_id + 1]).tolist())


def _write(folder: str, content_at, end: int):
    def run(batches):
        from pyspark import TaskContext

        writer, uri = None, f"{folder}/part-{(part := TaskContext.get().partitionId()):06d}.tok"
        for batch, at, to, ids in tokens.encoded(batches, content_at, end):
            writer = writer or Writer(uri)
            for doc_id, own in zip(batch.column(1).slice(at, to - at).to_pylist(), ids, strict=True):
                writer.add(doc_id, own)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "documents": len(writer.documents), "ids": writer.ids}])

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Writes all rows' ids, each followed by `end`, in ascending doc_id over all files. Returns (file, documents, ids) for each file, in order:
    one entry for each partition, whatever the number of rows.

    Null texts count as empty and give `end` alone; rows that repeat a doc_id follow each other, ordered by their text's hash; a null doc_id counts as NO_ID; an empty table
    writes no file.
    """
    set_up(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    content_at = spark.sparkContext.broadcast(tokens.load(tokenizer_path))
    rows = docs.select(text_of(text).alias("text"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"))
    rows = rows.repartitionByRange(parts(docs), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # many texts of one doc_id may lie in several files
    done = rows.mapInArrow(released(_write(folder, content_at, end), keeps=True), "part bigint, uri string, documents bigint, ids bigint").collect()
    return [(r["uri"], r["documents"], r["ids"]) for r in sorted(done)]


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            reader = Reader(row["uri"])
            for at in range(0, len(reader.documents), 10_000):
                crc = [zlib.crc32(reader.ids(i)) for i in range(at, min(at + 10_000, len(reader.documents)))]
                here = slice(at, at + len(crc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.documents["doc_id"][here]), pa.array(reader.start[here] + row["start"]), pa.array(reader.documents["ids"][here].astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_digests(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; every frame is checked on the way."""
    start, rows = 0, []
    for uri, _, ids in files:
        rows.append((uri, start))
        start += ids
    table = spark.createDataFrame(rows, "uri string, start bigint").repartition(max(1, len(rows)))
    rows = table.mapInArrow(released(_read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))

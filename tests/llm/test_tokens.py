"""Token ids, packing and token files: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomline.llm import packing, queries, token_files, tokens

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
WHOLE = Tokenizer.from_file(PATH)
EDGES = [(1, "a b  c\n\nd"), (1, "a b  c\n\nd"), (2, None), (3, ""), (None, "x"), (4, "word " * 70_000), (5, "é" * 9_000), (6, "\x00 \t "), (6, "later")]


def ids_of(text, end):
    return np.append(np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, "<u4"), end).astype("<u4").tobytes()


def test_pieces_give_the_ids_of_whole_texts():
    own, rng = tokens.Encoder(tokens.load(PATH)), random.Random(1)
    bits = ["a", "the", "Don't", "'s", "  ", "\n", " ", "\t", "é", "ß", "日本", "12", "3.5", ",", "...", "\x1c", "\xa0", "_", "-", "l'été", "\r\n", "²", "½", " \n", "'", "ll", "\x00", "😀", " ", "<|endoftext|>"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert own.encode([text], 1)[0] == ids_of(text, 1), repr(text)


def check_pieces(rows, docs):
    """docs: doc_id -> list of id strings. Every id lies in one piece; sequences are gapless and as long as they say."""
    left = {k: sorted(v) for k, v in docs.items()}
    for k, own in left.items():
        if len(own) == 1:
            at = 0
            for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0]) // 4 and zlib.crc32(own[0][4 * at : 4 * (at + r.length)]) == r.ids_crc32
                at += r.length
            assert at == len(own[0]) // 4
        else:
            assert sum(r.length for r in rows if r.doc_id == k) == sum(len(x) // 4 for x in own)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == r.padded_length <= 2048 and at & (at - 1) == 0


def test_packing_of_a_table(spark):
    docs = {r.doc_id: [ids_of(r.text, 1)] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_bounded_space_packing(spark, SF).collect()
    check_pieces(rows, docs)
    assert sum(r.length == 2048 or r.padded_length == 2048 for r in rows) > 0


def test_packing_edges(spark):
    docs = {}
    for k, t in EDGES:
        docs.setdefault(k, []).append(ids_of(t, 1))
    df = spark.createDataFrame([(a, b, 1) for a, b in EDGES], "doc_id bigint, text string, part int").repartition(3)
    rows = packing.pack(df, PATH, 1, with_ids=True).collect()
    check_pieces(rows, docs)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0), PATH, 1).collect() == []


def test_packer_keeps_few_windows_open():
    out, rng = [], random.Random(4)
    packer = packing.Packer(out.append, length=64, most_open=3)
    for i in range(400):
        packer.add(i, b"\x01\x00\x00\x00" * rng.randint(1, 150))
        assert len(packer.open) <= 3
    left = packer.finish()
    assert all(sum(len(p[2]) // 4 for p in w) == 64 for w in out) and sum(len(p[2]) // 4 for p in left) < 64


def test_token_files_of_a_table(spark):
    rows = sorted(queries.op4_seekable_token_files(spark, SF).collect())
    at = 0
    for r, doc in zip(rows, sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), strict=True):
        ids = ids_of(doc[1], 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc[0], at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_files_edges(spark):
    df = spark.createDataFrame([(a, b, "x") for a, b in EDGES], "doc_id bigint, text string, uri string")
    files = token_files.write_tokens(df, PATH, 2)
    rows = sorted(token_files.read_digests(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 6]
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(ids_of(t, 2)) for _, t in EDGES)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert token_files.read_digests(spark, token_files.write_tokens(df.limit(0), PATH, 2)).collect() == []


def test_readers_take_single_documents_and_notice_damage(tmp_path):
    uri = f"file://{tmp_path}/x.tok"
    writer, rng = token_files.Writer(uri), np.random.default_rng(1)
    docs = {i: rng.integers(0, 50_000, n).astype("<u4").tobytes() for i, n in enumerate([1, 5, 70_000, 140_000, 3])}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    reader = token_files.Reader(uri)
    for i in (3, 0, 4):
        assert [reader.ids(n) for n in reader.find(i)] == [docs[i]]
    assert list(reader.find(99)) == []
    raw = bytearray((tmp_path / "x.tok").read_bytes())
    raw[int(reader.frame_at[reader.first[3]]) + 50] ^= 1
    (tmp_path / "x.tok").write_bytes(raw)
    damaged = token_files.Reader(uri)
    assert damaged.ids(2) == docs[2]
    with pytest.raises(Exception):  # noqa: B017  zstandard's own checksum or ours
        damaged.ids(3)
    (tmp_path / "x.tok").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        token_files.Reader(uri)

"""Links of two tokenizers against a token by token version, also where texts are cut into spans and chunks, and edge cases."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fathomline.llm import alignment as A
from fathomline.llm.tokens import byte_letters

FILES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts):
    a_coder = Tokenizer.from_file(FILES[0])
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = {v: k for k, v in byte_letters().items()}
    bytes_a = {i: bytes(letters[c] for c in entry) for entry, i in a_coder.get_vocab().items()}

    def bytes_b(i):
        piece = b_coder.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_coder.is_byte(i) else piece.replace("▁", " ").encode()

    out, links, count = [], [], Counter()
    for text in texts:
        text = text or ""
        whole = (" " + text).encode()
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(map(bytes_b, b)) != whole:
            a = b = []
        groups, own_a, own_b, at_a, at_b, x, y = [], [], [], 0, 0, 0, 0
        while x < len(a) or y < len(b):
            if at_a <= at_b:
                own_a.append(a[x])
                at_a, x = at_a + len(bytes_a[a[x]]), x + 1
            else:
                own_b.append(b[y])
                at_b, y = at_b + len(bytes_b(b[y])), y + 1
            if at_a == at_b and own_a and own_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        links.append(Counter((p, q) for g, h in groups for p in g for q in h))
        count.update(links[-1].keys())
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append([len(a), len(b), len(groups), sum(links[-1].values()), hashlib.sha256(said.encode()).hexdigest() if a else ""])
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    return [(*o[:4], sum(m for pq, m in own.items() if count[pq] == top[pq[0]]), sum(m * count[pq] for pq, m in own.items()), o[4]) for o, own in zip(out, links, strict=True)]


ODD = [None, "", " ", "a ▁ b", "<|endoftext|> </s> <s><unk> x", "  two  spaces \n\n and\ttabs \r\n \x00 end ", "🙂é😀 naïve 你好 𝒳", "🙂é😀 naïve 你好 𝒳", "ab" * 3000, " " * 5000 + "x", "word " * 50_000]


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # spans and chunks within texts and between them; executors' Python is forked, so it sees these
        monkeypatch.setattr(A, "SLICE", 50)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_a string").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in A.link_counts(docs, *FILES).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_spans_and_chunks(monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    monkeypatch.setattr(A, "PIECE", 500)
    pair = A.pair_of(*A.load(*FILES))
    texts = ["The naïve reader, unlike others, reads on. " * 60, "short", "  odd   spaces " * 90]
    with duckdb.connect(config={"threads": 1}) as con:
        cut, whole = A.Chunk(con, pair), A.Chunk(con, pair)
        for i, t in enumerate(texts):
            assert sum(len(a) for a, _ in A.parted(pair, *pair.encode(t), most=500)) == len(pair.encode(t)[0])
            monkeypatch.setattr(A.parted, "__defaults__", (500,))
            cut.add((i,), t)
            monkeypatch.setattr(A.parted, "__defaults__", (1 << 20,))
            whole.add((i,), t)
        kept = pa.schema([("_0", pa.int64())])
        for x, y in zip(cut.batches(7, kept), whole.batches(7, kept), strict=True):
            assert x.equals(y)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "same text", 1), (None, "same text", 1), (3, None, 2)], "doc_id bigint, text string, chunk int")
    found = sorted(A.link_counts(docs, *FILES, keep=("doc_id", "chunk")).collect(), key=lambda r: r.chunk)
    assert [(r.doc_id, r.chunk, r.n_links, r.n_best, r.count_sum) for r in found] == [(None, 1, 2, 2, 4), (None, 1, 2, 2, 4), (3, 2, 0, 0, 0)]
    assert found[2].groups_sha256 == ""
    assert A.link_counts(docs.limit(0), *FILES).count() == 0


def test_each_different_unit_is_encoded_once_and_any_white_space_comes_out_right(monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    import random

    import pyarrow as pa

    pair, draw, asked = A.pair_of(*A.load(*FILES)), random.Random(5), []
    whole = pair.encode
    monkeypatch.setattr(pair, "encode", lambda text: (asked.append(len(text)), whole(text))[1])
    kept = pa.schema([("_0", pa.int64())])

    def rows(texts):
        with duckdb.connect(config={"threads": 1}) as con:
            chunk = A.Chunk(con, pair)
            for i, t in enumerate(texts):
                chunk.add((i,), t)
            table = pa.Table.from_batches(list(chunk.batches(7, kept)))
        return [tuple(r[n] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for r in table.to_pylist() if r["kind"] == 1]

    words = ["The", "naïve", "reader,", "unlike", "others,", "reads", "on.\nAnd", "on"]
    plain = [" ".join(draw.choices(words, k=200)) for _ in range(100)]
    found = rows(plain)
    assert sum(asked) < sum(map(len, plain)) / 50
    bits = [" ", " ", "\n", "a", "B", "é", "1", ".", ",", "'s", "▁", "\t", "\r", "你", "🙂", "-", " the", "\x1c", "\x85", "　", "ll"]
    odd = ["".join(draw.choices(bits, k=draw.randint(1, 30))) for _ in range(1500)]
    found += rows(odd)
    assert found == [(*r[:4], r[6]) for r in brute(plain + odd)]

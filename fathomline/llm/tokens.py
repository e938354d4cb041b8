"""Token ids of whole texts with a public tokenizer's file.

The file's byte-level BPE works pre-token by pre-token, so a text may be cut where a pre-token is sure to end: before a space or line end that follows something else, after
a line end, and between a Latin letter and a mark. Each different piece is encoded by the tokenizers library once and then
looked up; the ids of a text are those of its pieces, joined. Whole-text encoding gives the same ids (tests/llm compares them).

Texts are first parted at single spaces, which is fast and right unless white space meets white space; such a text is cut by the pattern instead.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa

from fathomline.llm.shared import held

#: Places where any text may be cut.
CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?*$%&#])")
#: Pieces that are one pre-token, whose bytes the library's model takes as they are.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*$%&#].*)", re.DOTALL)
#: Entries of the tables of a worker (the first has two generations of so many), and the longest piece in them.
BETWEEN_SPACES, PIECES, LONGEST = 260_000, 60_000, 64


def load(path: str) -> str:
    """The tokenizer file's content, to be broadcast: executors need not have the file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


class Uneven(Exception):
    """White space next to a space."""


def byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as they are, the rest as letters from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def word(self, piece: str) -> bytes:
        written = "\u0120" + piece[1:] if piece.isascii() and piece[0] == " " else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        if WORD.fullmatch(piece):
            out = self.word(piece)
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            self[piece] = out
        return out


class BetweenSpaces(dict):
    """What stands between two spaces, with the space before it. Words are kept, with and without marks; what spans lines seldom comes again and isn't. When the table is full it becomes the old one, from which what is
    used again moves on, so common words needn't be encoded again."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces, self.old = pieces, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, text: str) -> bytes:
        if (out := self.old.get(text)) is not None:
            self[text] = out
            return out
        if LETTERS.fullmatch(text):
            out = self.pieces.word(" " + text)
        elif not text or text[0].isspace() or text[-1].isspace():
            raise Uneven
        elif parts := MARKED.fullmatch(text):
            out = self[parts[1]] + b"".join(map(self.pieces.__getitem__, CUT.split(parts[2])))
            if "\n" in text:
                return out
        else:
            out = b"".join(map(self.pieces.__getitem__, CUT.split(" " + text)))
        if len(text) <= LONGEST:
            self[text] = out
        return out


class Encoder:
    """plain: the strings of special tokens inside texts are plain text."""

    def __init__(self, content: str, plain: bool = False) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        tokenizer.encode_special_tokens = plain
        self.pieces = Pieces(tokenizer)
        self.spaced = BetweenSpaces(self.pieces)

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the id `end`."""
        if len(self.spaced) > BETWEEN_SPACES:
            self.spaced.age()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        last, out = struct.pack("<I", end), []
        piece, spaced = self.pieces.__getitem__, self.spaced.__getitem__
        for text in texts:
            parts = text.split(" ")
            try:
                if parts[0][-1:].isspace():
                    raise Uneven
                first = b"".join(map(piece, CUT.split(parts[0])))
                out.append(first + b"".join(map(spaced, parts[1:])) + last)
            except Uneven:
                out.append(b"".join(map(piece, CUT.split(text))) + last)
        return out


_LOADED = held()


def encoder(content: str) -> Encoder:
    """One for each Python worker, which keeps its pieces from task to task."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(content)
    return _LOADED[key]


def encoded(batches, content_at, end: int, most: int = 4 << 20):
    """(batch, rows from, to, ids of each text as bytes) for batches whose first column is text without nulls, by pieces of bounded bytes."""
    coder = encoder(content_at.value)
    for batch in batches:
        column = batch.column(0)
        at, size = 0, 0
        lengths = np.diff(np.frombuffer(column.cast(pa.large_string()).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if batch.num_rows else []
        for to, n in enumerate(lengths, 1):
            size += n
            if size >= most or to == batch.num_rows:
                yield batch, at, to, coder.encode(column.slice(at, to - at).to_pylist(), end)
                at, size = to, 0

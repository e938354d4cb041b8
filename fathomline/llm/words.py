"""Vectorised words and shingles over Arrow string columns.

A column's bytes are hashed in one pass: every byte has a random 64-bit value, a word's hash is the polynomial of its bytes (one running
sum and one multiplication for each word), mixed with its length. Two words share a hash with a chance of about 2**-64.
Texts are UTF-8 and all separators are ASCII, so bytes may be classified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15)
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words parted by white space: all but \x20 and \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of digits, letters and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
CHUNK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 2**64))
    with np.errstate(over="ignore"):
        up = np.full(n, BASE, U)
        down = np.full(n, inverse, U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK_BYTES + 1:  # one very long text
        return _powers(n)
    if not _POWERS:
        _POWERS.append(_powers(CHUNK_BYTES + 1))
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts in them, one more than texts). Nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes (one row at least)."""
    _, offsets = bytes_of(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words of each text): byte spans of all words, none of which crosses the end of a text."""
    inside = np.zeros(len(data) + 1, bool)
    np.take(word_byte, data, out=inside[:-1])
    edge = np.empty(len(data) + 1, bool)
    edge[1:] = inside[1:] != inside[:-1]
    edge[0] = inside[0]
    opens = edge & inside
    # a text that starts with a word byte opens a word, and closes that of the text before
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[at] = inside[at]
    closes = edge & ~inside
    joined = at[(at > 0)]
    joined = joined[inside[joined] & inside[joined - 1]]
    closes[joined] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U)
        total[0] = 0
        np.cumsum(BYTE_VALUE[LOWER][data] * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word shingles, shingles of each text). A text of fewer words, but not none, has one: the whole sequence."""
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    total = int(n.sum())
    if not total:
        return np.zeros(0, U), n
    begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    place = np.arange(total) - np.repeat(begin[:-1], n) + np.repeat(firsts[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    with np.errstate(over="ignore"):
        out = np.zeros(total, U)
        padded = np.concatenate([words, np.zeros(k, U)])
        factor = U(1)
        for j in range(k):
            out += np.where(length > j, padded[place + j] * factor, U(0))
            factor = factor * U(0xC2B2AE3D27D4EB4F)
        return mix(out + length.astype(U) * U(0x165667B19E3779F9)), n


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes text by text, their number for each text)."""
    if not len(hashes):
        return hashes, counts
    text = np.repeat(np.arange(len(counts)), counts)
    by_hash = np.argsort(hashes)
    by_hash = by_hash[np.argsort(text[by_hash].astype(np.uint16 if len(counts) < 65536 else np.uint32), kind="stable")]  # a radix sort
    h, text = hashes[by_hash], text[by_hash]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.bincount(text[keep], minlength=len(counts))

"""Words and their hashes, for whole Arrow columns at once.

A word is a maximal run of bytes other than space and 09-0D; none of these occurs inside a UTF-8 sequence, so bytes
are enough. A word's 64-bit hash folds A-Z into a-z (unless asked not to). Hashes stand for words and shingles inside a
text or a pair of texts: two different ones agree with a probability of about 2**-64. What identifies texts among all texts
(classes, regions, items) has 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words up to so many bytes are hashed together; longer ones, of which a text holds few, one by one.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words begin and end, and for each text the number of its first word (one more at the end).
    kinds, by byte: words also end between bytes of kinds 1 and 2."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    begin, end = np.empty(len(data), bool), np.empty(len(data), bool)
    begin[0] = end[-1] = True
    begin[1:], end[:-1] = space[:-1], space[1:]
    if kinds is not None:
        k = kinds[data]
        cut = (k[1:] ^ k[:-1]) == 3
        begin[1:] |= cut
        end[:-1] |= cut
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = True
    end[inner - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(begin & word), np.flatnonzero(end & word) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each word; unless folded, capital letters count as other letters. Each 8 bytes are mixed in one after
    the other, which is no polynomial in the letters, so that no family of words collides by its structure."""
    if not len(starts):
        return np.zeros(0, U)
    data = LOWER[data] if fold else data
    parts, size = eights(data), ends - starts
    h, rows, k = mix(size.astype(U) + U(0x9E3779B97F4A7C15)), np.flatnonzero(size <= SHORT), 0
    while len(rows):
        x = parts[starts[rows] + k] & _FIRST_BYTES[np.minimum(size[rows] - k, 8)]
        h[rows] = mix(h[rows] ^ x * U(0xD1B54A32D192ED03))
        k += 8
        rows = rows[size[rows] > k]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def same_bytes(x: np.ndarray, starts: np.ndarray, y: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each pair of stretches of `size` bytes whether they are equal; x, y: eights() of the two arrays they lie in."""
    same, rows, k = np.ones(len(size), bool), np.flatnonzero(size <= SHORT), 0
    while len(rows):
        same[rows] &= (x[starts[rows] + k] ^ y[at[rows] + k]) & _FIRST_BYTES[np.minimum(size[rows] - k, 8)] == 0
        k += 8
        rows = rows[size[rows] > k]
    for i in np.flatnonzero(size > SHORT).tolist():
        a, b, n = int(starts[i]), int(at[i]), int(size[i])
        same[i] = np.array_equal(x[a : a + n - 7 : 8], y[b : b + n - 7 : 8]) and x[a + n - 8] == y[b + n - 8]
    return same


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's begin (one more at the end)."""
    data, offsets = flat(texts)
    starts, ends, first = bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def n_words(texts: pa.Array) -> np.ndarray:
    return np.diff(bounds(*flat(texts))[2])


_MUL = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def windows(h: np.ndarray, k: int, picks: list[int] | None = None) -> np.ndarray:
    """A hash of each k consecutive hashes (of the picked places among them), in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in picks if picks is not None else range(k):
        out = out * U(0xD1342543DE82EF95) + h[j : j + n] * _MUL[j % len(_MUL)]
    return mix(out + U(k))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about size bytes of text, so that arrays stay small; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).cumsum()
        at = 0
        while at < b.num_rows:
            done = n[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(n, done + size, "right")))
            yield b.slice(at, to - at)
            at = to

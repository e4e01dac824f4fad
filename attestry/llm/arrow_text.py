"""Words and word n-grams of Arrow batches of texts, as numpy arrays.

A word is a run of bytes outside U+0020 and U+0009 to U+000D. Word and n-gram hashes are 64-bit polynomial hashes
that are taken as differences of prefix sums, so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Words longer than this are hashed by blake2b: polynomials modulo 2**64 are weak on very long structured strings.
LONG_WORD = 128
_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE, BYTE_BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
WORD_BASE, WORD_BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: their byte ranges in data, hashes, and the first word of each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, keep: np.ndarray | slice) -> bytes:
        """The chosen words, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[keep].tolist(), self.end[keep].tolist()))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = IS_SPACE) -> Words:
    """data: bytes of all texts; text k is data[offsets[k]:offsets[k + 1]]. separators: of each byte value whether it ends a word."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    value = BYTE_VALUE[data]
    value *= powers(BYTE_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    size = end - start
    code = mix((total[end] - total[start]) * powers(BYTE_BACK, n + 1)[start] + size.astype(np.uint64))
    for k in np.flatnonzero(size > LONG_WORD):
        code[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return Words(data, start, end, np.searchsorted(start, offsets), code)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word and hash of each run of n words that lies in one text."""
    m = len(w.hash)
    if m < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(w.hash * powers(WORD_BASE, m), out=total[1:])
    text = w.text_of_word()
    at = np.flatnonzero(text[: m - n + 1] == text[n - 1 :])
    return at, mix((total[at + n] - total[at]) * powers(WORD_BACK, m)[at] + np.uint64(n))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about most bytes; a longer text is alone."""
    if len(texts) == 0:
        return
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, places, values = texts.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi

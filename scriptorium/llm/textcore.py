"""Vectorised word splitting and hashing over UTF-8 bytes.

A text column is handled as one byte array per slice of a batch.  All word
patterns used here are sets of bytes (code points from 0x80 on are word
characters in each of them), so words are runs of word bytes and never cut a
code point.  Hashes are 64-bit: polynomial over random byte values, then mixed;
sequences of words hash the words' hashes the same way with another base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.llm.runtime import released

#: Bytes of text handled at once; the working arrays take about 40 times as much.
SLICE_BYTES = 1 << 18

_U = np.uint64


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for each byte within one of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and everything beyond ASCII (texts are lower-cased first).
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as asked for so far."""

    def __init__(self, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.base = (_U(base), _U(inverse))
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = (self._grow(b, size) for b in self.base)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES = _Powers(0x9E3779B97F4A7C15)
_WORDS = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """The words of a slice of texts: byte ranges, hashes, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def sequence(self, i: int, n: int) -> bytes:
        return b" ".join(self.word(k) for k in range(i, i + n))


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> Words:
    """Words of the texts ``data[offsets[k]:offsets[k + 1]]``."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[edge[:n]] = False
        after[edge[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _BYTES.upto(n + 1)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    return Words(data, start, end, np.searchsorted(start, offsets), hashed)


def sequence_hash(word_hash: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, whatever text they are in; see ``inside_text``."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    up, down = _WORDS[which].upto(len(word_hash) + 1)
    total = np.zeros(len(word_hash) + 1, dtype=_U)
    np.cumsum(word_hash * up[: len(word_hash)], out=total[1:])
    return mix((total[n:] - total[:m]) * down[:m])


def inside_text(words: Words, n: int) -> np.ndarray:
    """For each run start of ``sequence_hash``: whether the run ends within its text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=bool)
    last = np.repeat(words.first[1:], words.counts)[:m]
    return np.arange(m) + n <= last


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string array of at most ``limit`` bytes each (a longer text stands alone), with bytes and offsets.

    A null text counts as empty.
    """
    released()  # no operator that keeps something in a worker reads its texts here
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    at = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if len(raw) > 2 and raw[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words_of(texts: pa.Array, is_word: np.ndarray, lower: bool, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in slices(texts, limit):
        yield lo, hi, split(data, offsets, is_word, lower)


def covered(starts: np.ndarray, lengths: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a run of ``lengths`` places from one of ``starts``."""
    delta = np.zeros(size + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0

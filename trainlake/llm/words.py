"""Words of whole Arrow batches as numpy hashes, and rolling hashes over them.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All functions
work on the UTF-8 bytes of many documents at once, so no Python code runs per
word.  Batches are cut into pieces of half a megabyte (at least one document),
which bounds the memory of the byte-wide arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 2**63)) * 2 + 1


_BYTE_BASE, _WORD_BASE = _odd(1), _odd(2)
_BYTE_CODE = np.random.default_rng(3).integers(1, 2**63, 256).astype(_U)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and extended as needed."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 600_000), base & (2**64 - 1), dtype=_U)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (public splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[starts:ends]`` for many slices at once."""
    sums = np.empty(len(values) + 1, _U)
    sums[0] = 0
    np.cumsum(values * _powers(base, len(values))[: len(values)], out=sums[1:])
    inverse = _powers(pow(base, -1, 2**64), len(values))
    return (sums[ends] - sums[starts]) * inverse[starts]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


class Words:
    """The words of some consecutive documents.

    ``hashes``: one 64-bit value per word; ``first``: index of each document's
    first word, with the total at the end; ``start``/``end``: byte positions;
    ``origin``: byte position of each document.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        lo, hi = int(offsets[0]), int(offsets[-1])
        b, cuts = data[lo:hi], offsets - lo
        self.bytes = b
        self.origin = cuts[:-1]
        n = len(b)
        space = _SPACE[b]
        word = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        inner = cuts[(cuts > 0) & (cuts < n)]
        before[inner] = True
        after[inner - 1] = True
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, cuts)
        codes = _BYTE_CODE[_LOWER[b]] if lower else _BYTE_CODE[b]
        self.hashes = mix(runs(codes, _BYTE_BASE, self.start, self.end)) if n else np.zeros(0, _U)

    def __len__(self) -> int:
        return len(self.hashes)

    def doc_of(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``n`` words from each word on; only meaningful inside one document."""
        count = max(len(self) - n + 1, 0)
        at = np.arange(count)
        return mix(runs(self.hashes ^ _U(_odd(100 + seed) if seed else 0), _WORD_BASE, at, at + n))


_LETTER = np.ones(256, bool)
_LETTER[:0x80] = [chr(c).isalnum() for c in range(0x80)]


def bare(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes in lower case, and the bounds of each word without the ASCII punctuation around it.

    Lower case covers A-Z and the accented capitals of the Latin-1 block.  A
    word of punctuation alone stays whole.
    """
    b = words.bytes.copy()
    b[(b >= ord("A")) & (b <= ord("Z"))] += 32
    b[np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1] += 32
    at, letter = np.arange(len(b)), _LETTER[b]
    last = np.maximum.accumulate(np.where(letter, at, -1))[words.end - 1] + 1
    first = np.minimum.accumulate(np.where(letter, at, len(b))[::-1])[::-1][words.start]
    inside = (first >= words.start) & (last <= words.end) & (first < last)
    return _BYTE_CODE[b], np.where(inside, first, words.start), np.where(inside, last, words.end)


def spelled(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of many slices."""
    return runs(codes, _BYTE_BASE, starts, ends)


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment (sorts in place), and their offsets."""
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if e - s > 1:
            values[s:e].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return values[new], sums[offsets]


def pieces(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first document, one past the last, their words) over a batch."""
    data, offsets = utf8(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1)
        yield i, j, Words(data, offsets[i : j + 1], lower)
        i = j


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``n``-word shingles of each document, as values and offsets.

    A document with fewer than ``n`` words, but at least one, has its whole
    sequence as its only shingle.
    """
    first = words.first
    counts = np.diff(first)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(size)])
    values = np.empty(out[-1], _U)
    long = counts >= n
    if long.any():
        grams = words.grams(n)
        at = np.repeat(first[:-1][long] - out[:-1][long], size[long])
        to = np.flatnonzero(np.repeat(long, size))
        values[to] = grams[to + at]
    short = (counts > 0) & ~long
    if short.any():
        values[out[:-1][short]] = mix(runs(words.hashes, _WORD_BASE, first[:-1][short], first[1:][short]) ^ counts[short].astype(_U))
    return distinct(values, out)

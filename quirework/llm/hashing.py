"""Vectorised hashing of texts: words, word n-grams, lines and byte windows.

A batch of texts is one byte buffer. ``PrefixHash`` sums ``R[byte] * B**i`` along it
(arithmetic modulo 2**64, B odd and therefore invertible), so the hash of any slice
is a difference of two sums times a power of the inverse: no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: \x20 and \x09-\x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n well mixed 64-bit values from a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(_BASE))


_BYTE = stream(7, 256)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        step = np.full(size, U64(_BASE if kind == "up" else _INVERSE), dtype=U64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def forget() -> None:
    """Lets go of powers beyond a usual batch's."""
    for kind in [k for k, v in _powers.items() if len(v) > 1 << 20]:
        del _powers[kind]


class PrefixHash:
    """Hashes of any slices of a byte buffer, vectorised over the slices."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, dtype=U64)
        np.cumsum(_BYTE[data] * _power("up", self.n), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _power("down", self.n + 1)[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Batch:
    """Texts laid end to end with one newline after each; offsets tell whose byte is whose."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n, self.lengths = len(texts), lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.space = SPACE[self.data]
        self.hash = PrefixHash(self.data)
        edge = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        if len(self.data) and not self.space[0]:
            edge = np.concatenate([[0], edge])
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.words = self.hash.slices(self.word_start, self.word_end)
        #: words of text i are [word_of[i], word_of[i + 1])
        self.word_of = np.searchsorted(self.word_start, self.starts)

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_of)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; one rolling multiply-add for each word of the window."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    count = len(words) - n + 1
    out = words[:count].copy()
    for j in range(1, n):
        out *= U64(0xD1342543DE82EF95)
        out += words[j : j + count]
    return mix(out)


def owners(bounds: np.ndarray, total: int) -> np.ndarray:
    """For items laid out by bounds (n + 1 offsets), whose each is."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) if total else np.zeros(0, dtype=np.int64)


def chunks(rows: Iterable, size_of, limit: int) -> Iterator[list]:
    """Consecutive rows in lists of about ``limit`` bytes; one row may be larger."""
    held, size = [], 0
    for row in rows:
        if held and size + size_of(row) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += size_of(row)
    if held:
        yield held

"""Word and shingle hashing in numpy, for Python workers.

Texts are hashed straight from the bytes of an Arrow column. A word's hash is a polynomial in its bytes, read off one
running sum over many texts, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31, S33 = (np.uint64(x) for x in (27, 30, 31, 33))
#: Ratios of the polynomials over bytes and over words: odd, and 3 modulo 4, so that swapped terms lose a single bit.
BYTE_RATIO, WORD_RATIO = 0xD1342543DE82EF97, 0x9E3779B97F4A7C17
#: Bytes hashed at a time, and bytes of texts handed out together.
PIECE = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def finish(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> S30)) * C2
    x = (x ^ (x >> S27)) * C3
    return x ^ (x >> S31)


class Powers:
    """Powers of a ratio and of its inverse modulo 2 ** 64, grown on demand."""

    def __init__(self, ratio: int):
        self.ratio, self.up, self.down = ratio, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            series = lambda r: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, r, np.uint64), dtype=np.uint64)])
            self.up, self.down = series(self.ratio), series(pow(self.ratio, -1, 1 << 64))

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomials of ``values[start:end]``, whatever their position."""
        self.reach(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=total[1:])
        return (total[end] - total[start]) * self.down[start]


def hash_bytes(b: np.ndarray, powers: Powers, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words in ``b``; no word crosses the positions ``breaks``. Works piece by piece."""
    edge = np.zeros(len(b) + 1, bool)
    edge[breaks] = True
    starts, hashes, at = [], [], 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        if end < len(b):  # cut before the word that the limit falls into, or behind it if it fills the piece
            stop = np.flatnonzero(BLANK[b[at:end]])
            if len(stop):
                end = at + int(stop[-1]) + 1
            else:
                rest = np.flatnonzero(BLANK[b[end:]])
                end = end + int(rest[0]) if len(rest) else len(b)
        part, cut = b[at:end], edge[at : end + 1].copy()
        solid = ~BLANK[part]
        cut[0] = cut[-1] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = powers.spans(part.astype(np.uint64) + np.uint64(1), s, e)
        starts.append(s + at)
        hashes.append(finish(h ^ ((e - s).astype(np.uint64) * C1)))
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


class Texts:
    """Word hashes of a text column, in groups of whole texts."""

    def __init__(self) -> None:
        self.byte_powers, self.word_powers = Powers(BYTE_RATIO), Powers(WORD_RATIO)

    def groups(self, column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, word hashes, bounds): the words of row ``first + i`` are ``w[bounds[i]:bounds[i + 1]]``."""
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        b = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(o, o[i] + PIECE, "right")) - 1)
            part = b[o[i] : o[j]]
            if lower:
                part = SMALL[part]
            start, w = hash_bytes(part, self.byte_powers, (o[i : j + 1] - o[i]))
            yield i, w, np.searchsorted(start, o[i : j + 1] - o[i])
            i = j

    def rows(self, column: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
        """Word hashes of one row after another."""
        for _, w, bounds in self.groups(column, lower):
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield w[a:z]


def window_hash(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words; empty when there are fewer words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = w[:n] * C1
    for j in range(1, k):
        h = (h ^ (h >> S33)) * C2 + w[j : n + j]
    return finish(h)


def shingle_set(w: np.ndarray, k: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; the whole sequence as one when shorter, none without words."""
    if not len(w):
        return w
    return np.unique(window_hash(w, min(k, len(w))) ^ np.uint64(0 if len(w) >= k else len(w)))


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()

"""Five-word shingles as sorted 64-bit hashes, and their compact form for shuffles."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash
import zstandard

from .common import Kept

#: Words of a shingle, and the part of the union that two linked sets share at least, in percent.
WORDS, PERCENT = 5, 80


class WordHashes(Kept):
    """Hash of each word."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of(self, words: list[list[bytes]], total: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.uint64, total)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = h[:n].copy()
    for j in range(1, k):
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += h[j : j + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """The set of each text, sorted: lower-case A-Z, words between ASCII white space, the whole sequence if it is short."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    rolled = windows(hashes.of(words, int(counts.sum())), WORDS)
    starts, out = np.cumsum(counts) - counts, []
    for w, n, at in zip(words, counts.tolist(), starts.tolist()):
        if n >= WORDS:
            out.append(distinct_sorted(rolled[at : at + n - WORDS + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as byte planes, compressed; the first, sorted, as differences."""
    planes = []
    for i, column in enumerate(columns):
        c = column.astype(np.uint64)
        if i == 0:
            c = np.diff(c, prepend=np.uint64(0))
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in raw.reshape(columns, 8, -1)]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out

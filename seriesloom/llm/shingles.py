"""Word and shingle hashes shared by the near-duplicate stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seriesloom.llm.common import distinct

CHUNK_BYTES = 2 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(29)


class WordHasher:
    """64-bit hashes of the words of texts, by sums of powers; equal words, equal hash."""

    PIECE = 2 << 20
    _BASE = 0xD1342543DE82EF95
    _LETTERS = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            for name, base in (("up", self._BASE), ("down", pow(self._BASE, -1, 1 << 64))):
                run = np.full(n + 1, np.uint64(base), np.uint64)
                run[0] = 1
                setattr(self, name, np.cumprod(run))

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and their hashes."""
        self._powers(len(data))
        edge = np.diff(self._SPACE[data].astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._LETTERS[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= _K
        return start, h ^ (h >> _R)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, lower-cased (A-Z), in order, and the number of words of each text."""
        joined = b" ".join(texts).lower()
        data = np.frombuffer(joined, np.uint8)
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = at + self.PIECE
            while end < len(data) and not self._SPACE[data[end]]:  # pieces end with a word
                more = np.flatnonzero(self._SPACE[data[end : end + self.PIECE]])
                end += int(more[0]) if len(more) else self.PIECE
            s, h = self._piece(data[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.append(np.cumsum(sizes) - sizes, len(data) + 1)
        found = np.concatenate([np.zeros(0, np.int64), *starts])
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.diff(np.searchsorted(found, begins))


def shingle_sets(texts: list[bytes], hasher: WordHasher, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text.

    A text of fewer words is one shingle, its whole sequence; without words
    the set is empty.
    """
    flat, sizes = hasher.words(texts)
    n = max(0, len(flat) - k + 1)
    mixed = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        mixed ^= flat[j : j + n]
        mixed *= _K
        mixed ^= mixed >> _R
    out, at = [], 0
    for m in sizes.tolist():
        if m >= k:
            out.append(distinct(mixed[at : at + m - k + 1]))
        elif m:
            h = np.uint64(m)
            with np.errstate(over="ignore"):
                for x in flat[at : at + m]:
                    h = (h ^ x) * _K
                    h ^= h >> _R
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and encoded texts of (doc_id, text) batches, about ``limit`` bytes at a time."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch["doc_id"], batch["text"], strict=True):
            b = (t.as_py() or "").encode()
            ids.append(i.as_py())
            texts.append(b)
            size += len(b)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def signature_words(n: int, most: int = 128) -> int:
    """64-bit words of the bitmap of a set of n: a power of two, 4 to 8 bits an element."""
    return min(most, 1 << max(1, (n // 16).bit_length()))


def bitmap(s: np.ndarray, words: int) -> np.ndarray:
    """Hashed bitmap: bit (hash mod bits) set for each element."""
    bits = s & np.uint64(words * 64 - 1)
    out = np.zeros(words * 64, np.uint8)
    out[bits.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer bits, as if hashed so: bits (mod words * 64) are joined."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)

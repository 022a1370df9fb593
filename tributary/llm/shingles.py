"""Word shingles and MinHash signatures of one text (helpers that run inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_CACHE_WORDS = 150_000
_BLOCK = 4096


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds ``_CACHE_WORDS`` words. A task makes its own, so
    an idle worker keeps nothing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words: maximal runs without space and \\x09-\\x0d, which is bytes.split()."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = WIDTH, cache: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles.

    A text with fewer words has one shingle, its whole word sequence; no words give none.
    """
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hash_of = WordHashes() if cache is None else cache
    ids = np.fromiter(map(hash_of.__getitem__, words), np.uint64, n)
    span = min(n, width)
    h = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        h = h * _MULT + ids[j : n - span + 1 + j]
    return np.unique(_mix(h))


def permutations(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, k, dtype=np.uint64)


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int32 signature: for each permutation the top 32 bits of the least permuted hash."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), _BLOCK):
        block = hashes[s : s + _BLOCK, None] * a + b
        np.minimum(best, block.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)

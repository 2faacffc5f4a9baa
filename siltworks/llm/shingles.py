"""Word shingles and MinHash signatures of whole batches of texts by array operations."""

from __future__ import annotations

import numpy as np

from .bpe import ragged

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(7_919)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE to the power of a place in a word, as many as the longest word so far needs."""

    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            with np.errstate(over="ignore"):
                self.table = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, BASE, np.uint64)]))
        return self.table


POWERS = Powers()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts in order, number of words of each text, their last bytes, the bytes
    before those, or 0)."""
    counts = np.zeros(len(texts), np.int64)
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    white = SPACES[raw]
    inner = ~white
    starts = np.flatnonzero(inner & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    ends = np.flatnonzero(inner[:-1] & white[1:]) + 1
    lengths = ends - starts
    at = ragged(starts, lengths)
    before = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(before, lengths)
    hashes = np.add.reduceat(BYTE_VALUES[raw[at]] * POWERS.upto(int(lengths.max()))[place], before)
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts[:] = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    second = np.where(lengths > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.uint8)
    return mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts, raw[ends - 1], second


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (ASCII letters lower-cased). Fewer words than width: the whole
    sequence as one shingle; no words: empty."""
    hashes, counts, _, _ = words([t.lower() for t in texts])
    out = []
    end = 0
    for n in counts.tolist():
        own = hashes[end : end + n]
        end += n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        w = min(width, n)
        h = np.full(n - w + 1, np.uint64(w) * np.uint64(0x632BE59BD9B4E019), np.uint64)
        for i in range(w):
            h = (h ^ own[i : n - w + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out.append(np.unique(mix(h)))
    return out


def minhash_factors(coordinates: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, (2, coordinates), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray, rows: int = 512) -> np.ndarray:
    """The upper 32 bits of the least value of each coordinate's hash over a set that is not empty."""
    a, b = factors
    out = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), rows):
        h = shingles[i : i + rows, None] * a
        h ^= h >> np.uint64(32)
        h *= b
        np.minimum(out, h.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)

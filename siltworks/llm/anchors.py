"""Content-defined anchors: the least hash of the k-byte strings in each window of a text.

Two equal windows have equal anchors wherever they are. So all windows of one anchor can be compared apart from all
others, and a run of neighbouring windows with one anchor is handled as one segment.
"""

from __future__ import annotations

import numpy as np

from .shingles import BYTE_VALUES, mix

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Hasher:
    """Hashes of whole batches of texts; keeps powers of the base for the longest batch so far."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = 2 * n
            for name, base in (("powers", BASE), ("inverse", BASE_INVERSE)):
                setattr(self, name, np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)])))

    def strings(self, values: np.ndarray) -> np.ndarray:
        """The hash of the k bytes from each place, by doubling."""
        h, width, out, done = values, 1, None, 0
        k = self.k
        while True:
            if k & 1:
                out = h if out is None else out[: len(h) - done] * np.uint64(pow(BASE, width, 1 << 64)) + h[done:]
                done += width
            k >>= 1
            if not k:
                return mix(out)
            h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
            width *= 2

    def sliding_least(self, h: np.ndarray) -> np.ndarray:
        """The least hash of each window's strings."""
        most = self.window - self.k + 1
        width, m = 1, h
        while 2 * width <= most:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        return np.minimum(m[: len(h) - most + 1], m[most - width : most - width + len(h) - most + 1])

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All segments: (text, first window's start, number of windows, anchor, hash of the segment's bytes)."""
        lengths = np.array([len(t) for t in texts])
        if not len(texts) or lengths.max() < self.window:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        self._grow(n + 1)
        values = BYTE_VALUES[raw]
        h = self.strings(values)
        least = self.sliding_least(h)
        begins = np.cumsum(lengths) - lengths
        windows = np.maximum(0, lengths - self.window + 1)
        cut = np.empty(len(least), bool)
        cut[0] = True
        np.not_equal(least[1:], least[:-1], out=cut[1:])
        cut[1:] |= h[: len(least) - 1] == least[:-1]
        full = windows > 0
        cut[begins[full]] = True
        # windows across texts belong to none
        valid = np.zeros(len(least) + 1, np.int64)
        np.add.at(valid, begins[full], 1)
        np.add.at(valid, (begins + windows)[full], -1)
        valid = np.cumsum(valid[:-1]) > 0
        start = np.flatnonzero(cut & valid)
        stops = np.flatnonzero(cut | np.concatenate([[True], valid[1:] != valid[:-1]]))
        after = np.append(stops, len(least))[np.searchsorted(stops, start, side="right")]
        text = np.searchsorted(begins, start, side="right") - 1
        # empty texts begin where the next one does: take the one that has windows there
        text = np.flatnonzero(full)[np.searchsorted(begins[full], start, side="right") - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * self.powers[:n])])
        content = mix((sums[after - 1 + self.window] - sums[start]) * self.inverse[start])
        return text, start - begins[text], after - start, least[start], content

"""Points of a plane by rank: a wavelet matrix that reports all points in many rectangles at once."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Of a permutation: for x = 0, 1, ... the point (x, y[x])."""

    def __init__(self, y: np.ndarray):
        self.bits = max(1, int(len(y) - 1).bit_length()) if len(y) else 0
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (y >> b) & 1 == 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(y) - int(self.ones[-1][-1]))
            y = np.concatenate([y[~bit], y[bit]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles left <= x < right, low <= y < high: the number of the rectangle and y of each point inside."""
        of = np.flatnonzero((left < right) & (low < high))
        left, right, value = left[of], right[of], np.zeros(len(of), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            b = self.bits - 1 - level
            left1, right1 = ones[left], ones[right]
            of, value = np.concatenate([of, of]), np.concatenate([2 * value, 2 * value + 1])
            left, right = np.concatenate([left - left1, zeros + left1]), np.concatenate([right - right1, zeros + right1])
            inside = np.flatnonzero((left < right) & ((value + 1 << b) > low[of]) & ((value << b) < high[of]))
            of, value, left, right = of[inside], value[inside], left[inside], right[inside]
        return of, value

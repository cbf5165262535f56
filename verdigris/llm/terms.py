"""Runs of letters in whole Arrow columns of texts, and what a slice of them holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where maximal runs of inside bytes begin and end, none across texts, and the text of each. offsets: of the texts."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    begin[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def covering(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """For each of size bytes whether one of the (disjoint) runs holds it."""
    change = np.zeros(size + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    return np.cumsum(change[:-1], dtype=np.int8).astype(bool)


def strings(data: np.ndarray, size: np.ndarray) -> pa.LargeStringArray:
    """data cut into strings of these sizes."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))

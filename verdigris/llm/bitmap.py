"""A filter of bounded size: which hashes a (possibly huge) table holds, with few false hits and no misses.

It only saves work ahead of an exact join. It has 2**bits bits, MOST at most (128 MB), in 32 kB blocks that executors
build and of which the driver gets at most one each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.text import U, mix

BITS, MOST, BLOCK = 26, 30, 18


def bits_for(n: int) -> int:
    """At least 16 bits for each of n hashes, within the bounds."""
    return min(MOST, max(BLOCK, (16 * n).bit_length()))


def places(h: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers for each hash."""
    a = mix(h ^ U(0x5851F42D4C957F2D))
    return a >> U(64 - bits), a & U((1 << bits) - 1)


def build(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """Of the table's only column, of type long."""
    column = hashes.columns[0]

    def bit_numbers(batches):
        import pyarrow as pa

        for b in batches:
            n = np.unique(np.concatenate(places(b.column(0).to_numpy().view(U), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n >> BLOCK), pa.array(n & ((1 << BLOCK) - 1))], names=["block", "bit"])

    def fill(rows):
        import pyarrow as pa

        mask = np.zeros(1 << BLOCK, bool)
        mask[rows.column("bit").to_numpy()] = True
        return pa.table({"block": rows.column("block")[:1], "mask": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())})

    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (BLOCK - 3)
    pairs = hashes.select(F.col(column).alias("h")).where("h is not null").mapInArrow(bit_numbers, "block long, bit long").distinct()
    for r in pairs.groupBy("block").applyInArrow(fill, "block long, mask binary").collect():
        bitmap[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["mask"], np.uint8)
    return bitmap


def hits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash whether the table may hold it."""
    a, b = places(h, (len(bitmap) * 8).bit_length() - 1)
    seven, three = U(7), U(3)
    return ((bitmap[a >> three] >> (a & seven).astype(np.uint8)) & (bitmap[b >> three] >> (b & seven).astype(np.uint8)) & np.uint8(1)).astype(bool)

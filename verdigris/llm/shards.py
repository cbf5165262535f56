"""Histogram sort of documents into shards of nearly equal bytes.

Documents are ordered by (hash of the text, doc_id), so equal texts are neighbours. Each round counts exactly the bytes
and rows below a set of probe keys, in every partition, and places new probes between the two that enclose each
splitter's target, until all splitters meet the tolerance; only then are rows exchanged, once. A probe falls inside a
group of equal texts only where the group is larger than the tolerance; such a group is cut by doc_id.

Defined cases: a null text has no bytes and a checksum of 0; a null doc_id sorts first; rows that agree in doc_id and
text share one key and so one shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.shared import work_dir, written

LOW = 1 << 63
SHARDS, TOLERANCE, ROWS_PER_RANGE = 8, 0.001, 1_000_000
#: Ranges together, whatever the number of rows (larger ones sort on disk); probes for a splitter and, at least, for all.
RANGES, PROBES, ALL_PROBES = 2048, 48, 16_384


def keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-LOW)).alias("d"))


def _split(key: int) -> tuple[int, int]:
    return (key >> 64) - LOW, (key & (2**64 - 1)) - LOW


def ranks(h: np.ndarray, d: np.ndarray, ph: np.ndarray, pd: np.ndarray) -> np.ndarray:
    """For each key the number of probes at or below it; probes are sorted."""
    lo, out = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    tied = np.flatnonzero(lo < out)
    for value in np.unique(h[tied]):
        rows = tied[h[tied] == value]
        a, b = np.searchsorted(ph, value, "left"), np.searchsorted(ph, value, "right")
        out[rows] = a + np.searchsorted(pd[a:b], d[rows], "right")
    return out


def below(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows with a key below each probe, exactly."""
    ph, pd = (np.array(x, np.int64) for x in zip(*map(_split, probes), strict=True))

    def count(batches):
        size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        for b in batches:
            at = ranks(b.column("h").to_numpy(), b.column("d").to_numpy(), ph, pd)
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        k = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(size[k]), pa.array(rows[k])], names=["k", "size", "n"])

    sums = keys.select("h", "d", "size").mapInArrow(count, "k long, size long, n long").groupBy("k").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
    for r in sums:
        size[r["k"]], rows[r["k"]] = r["size"], r["n"]
    return list(zip(size.cumsum()[:-1].tolist(), rows.cumsum()[:-1].tolist(), strict=True))


def splitters(keys: DataFrame, total: tuple[int, int], ids: tuple[int, int], targets: list[float], slack: list[float]) -> list[tuple[int, int, int]]:
    """For each target number of bytes a key with nearly as many below it, and exactly how many bytes and rows are."""
    found: list[tuple[int, int, int] | None] = [None] * len(targets)
    ends = [((0, 0, 0), (1 << 128, *total)) for _ in targets]
    low, high = ids[0] + LOW, ids[1] + LOW + 1
    while None in found:
        asked: dict[int, set[int]] = {}
        n = max(4, min(PROBES, ALL_PROBES // sum(x is None for x in found)))
        for j, (a, b) in enumerate(ends):
            if found[j]:
                continue
            near = min(a, b, key=lambda x: abs(x[1] - targets[j]))
            if abs(near[1] - targets[j]) <= slack[j] or b[2] - a[2] <= 1:
                found[j] = near
                continue
            if b[0] - a[0] > 1 << 64:
                x, y = a[0] >> 64, b[0] >> 64
                new = {(x + (y - x) * i // (n + 1)) << 64 for i in range(1, n + 1)} | {(x + 1) << 64}
            else:
                top = a[0] >> 64 << 64
                x, y = max(a[0], top + low), min(b[0], top + high)
                new = {x + (y - x) * i // (n + 1) for i in range(1, n + 1)}
            asked[j] = {p for p in new if a[0] < p < b[0]}
            if not asked[j]:
                found[j] = near
        probes = sorted(set().union(*asked.values())) if asked else []
        if not probes:
            break
        counted = dict(zip(probes, below(keys, probes), strict=True))
        for j in asked:
            if found[j]:
                continue
            a, b = ends[j]
            for p in asked[j]:
                x = (p, *counted[p])
                if x[1] <= targets[j] and x[0] > a[0]:
                    a = x
                if x[1] >= targets[j] and x[0] < b[0]:
                    b = x
            ends[j] = (a, b)
    return sorted(x or (0, 0, 0) for x in found)


def histogram_sort(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: rows in key order; slots run without a gap in each shard. tolerance: of a
    shard's bytes. Large shards are cut into ranges that are sorted alone; exact counts give each range its first slot. What
    the driver holds depends on the number of ranges and probes, not on the rows."""
    spark = docs.sparkSession
    keys = written(keyed(docs), work_dir(spark, "keys"))
    t = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).first()
    if not t["n"]:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    parts = max(1, min(-(-t["n"] // (shards * rows_per_range)), RANGES // shards))
    targets = [t["size"] * k / (shards * parts) for k in range(1, shards * parts)]
    each = t["size"] / shards
    cuts = splitters(keys, (t["size"], t["n"]), (t["a"], t["b"]), targets, [each * (tolerance if k % parts == 0 else 0.25 / parts) for k in range(1, shards * parts)])
    ph, pd = (np.array(x, np.int64) for x in zip(*(_split(min(c[0], 2**128 - 1)) for c in cuts), strict=True)) if cuts else (np.zeros(0, np.int64),) * 2
    rows = np.array([0, *(c[2] for c in cuts)], np.int64)
    first = rows - rows[np.arange(len(rows)) // parts * parts]

    def placed(batches):
        for b in batches:
            r = ranks(b.column("h").to_numpy(), b.column("d").to_numpy(), ph, pd)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int32)), pa.array(first[r])], names=[*b.schema.names, "range", "first"])

    out = keys.mapInArrow(placed, "doc_id long, size long, text_crc32 long, h long, d long, range int, first long")
    slot = F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy("h", "d", "size", "text_crc32")) - 1
    return out.select("doc_id", "size", "text_crc32", F.expr(f"range div {parts}").cast("int").alias("shard"), slot.cast("bigint").alias("slot"))

"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over SPAN words ignore some places, so a seed survives substituted words there. The masks lose nothing: of
LEAST words or more of which SHARE agree, however the others lie, some mask always has all its places among those that
agree (a test proves it). Seeds of the benchmark fill a filter of fixed size; where a training text hits it, the hits'
surroundings (a region, as far as the longest item can reach) are kept, and only these rows take part in the exact join of
seed hashes. For each region, item and alignment that share a seed, the longest stretch without gaps in which at least
SHARE of the words agree is found; it counts from LEAST words on. Items of fewer words are seeded as a whole and count
where they occur word for word; items of fewer than SHORTEST words are no evidence and match nothing.

Equal regions are verified once, whatever the number of texts they occur in, and equal items likewise; both are known by
128-bit hashes.

Defined cases: null, empty and blank texts and items match nothing; A-Z count as a-z; a null id is kept; repeated rows
give one row for each pair of ids; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import bitmap
from verdigris.llm.shared import work_dir, written
from verdigris.llm.text import U, hashed, mix, slices, windows

# Places that each mask looks at.
MASKS = ((0, 1, 2, 4, 5, 9), (0, 1, 3, 4, 5, 6), (0, 1, 3, 7, 8, 9), (0, 1, 5, 7, 8, 9), (0, 2, 3, 5, 6, 9))
SPAN, LEAST, SHARE, SHORTEST = 10, 12, (4, 5), 6


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(_body(words), digest_size=16).digest()


def _body(words: np.ndarray) -> bytes:
    return words.astype("<u8").tobytes()


def _words(body: bytes) -> np.ndarray:
    return np.frombuffer(body, "<u8").astype(U, copy=False)


def seeds(h: np.ndarray, short: tuple[int, ...]) -> list[tuple[np.ndarray, int]]:
    """Hashes of all seeds at each place, by mask; and of whole windows of the lengths in short."""
    out = [(windows(h, SPAN, list(m)) ^ U(k + 1), SPAN) for k, m in enumerate(MASKS)]
    return out + [(windows(h, n) ^ U(n << 8), n) for n in short]


def _items(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """item (the words' hash), item_id, n, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, first = hashed(b.column("text"))
            own = [h[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
            keep = [i for i, w in enumerate(own) if len(w) >= SHORTEST]
            yield pa.RecordBatch.from_arrays([pa.array([_key(own[i]) for i in keep], pa.binary()), b.column("item_id").take(pa.array(keep, pa.int64())), pa.array([len(own[i]) for i in keep], pa.int64()), pa.array([_body(own[i]) for i in keep], pa.binary())], names=["item", "item_id", "n", "body"])

    return items.selectExpr(f"cast(`{item_id}` as bigint) item_id", f"`{text}` text").mapInArrow(run, "item binary, item_id long, n long, body binary")


def _item_seeds(bodies: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, item, at = [], [], []
            for key, body in zip(b.column("item").to_pylist(), b.column("body").to_pylist(), strict=True):
                w = _words(body)
                for x, _ in seeds(w, ()) if len(w) >= LEAST else seeds(w, (len(w),))[len(MASKS) :]:
                    h.append(x.view(np.int64))
                    item += [key] * len(x)
                    at.append(np.arange(len(x)))
            numbers = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (h, at)]
            yield pa.RecordBatch.from_arrays([numbers[0], pa.array(item, pa.binary()), numbers[1]], names=["h", "item", "item_at"])

    return bodies.select("item", "body").mapInArrow(run, "h long, item binary, item_at long")


def _regions(docs: DataFrame, text: str, doc_id: str, sent, short: tuple[int, ...], reach: int) -> DataFrame:
    """region (its words' hash), doc_id, h (the whole text's hash), at (its first word's number), body: filter hits and
    `reach` words around them, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, first = hashed(b.column("text"))
            hit = np.zeros(len(h) + 1, bool)
            for x, n in seeds(h, short):
                at = np.flatnonzero(bitmap.hits(sent.value, x))
                inside = at + n <= first[np.searchsorted(first, at, "right")]
                hit[at[inside]] = True
            places = np.flatnonzero(hit)
            of = np.searchsorted(first, places, "right") - 1
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (np.diff(places) > 2 * reach)])) if len(places) else []
            rows = []
            for a, z in zip(new, [*new[1:], len(places)], strict=True) if len(places) else ():
                d = of[a]
                lo, hi = max(first[d], places[a] - reach), min(first[d + 1], places[z - 1] + SPAN + reach)
                rows.append((_key(h[lo:hi]), d, int(lo - first[d]), _body(h[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(b.column(c).take(pa.array([r[1] for r in rows], pa.int64())) for c in ("doc_id", "h")), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["region", "doc_id", "h", "at", "body"])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"xxhash64(`{text}`) h", f"`{text}` text").mapInArrow(run, "region binary, doc_id long, h long, at long, body binary")


def overlap(region: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The longest stretch, the item's word 0 lying at the region's word shift, in which SHARE of the words agree:
    its first word in the region, its length and how many agree. None if it is too short; an item of fewer than LEAST
    words must agree as a whole."""
    lo, hi = max(0, shift), min(len(region), shift + len(item))
    same = region[lo:hi] == item[lo - shift : hi - shift]
    if len(item) < LEAST:
        return (shift, len(item), len(item)) if len(same) == len(item) and same.all() else None
    good, of = SHARE
    total = np.concatenate([[0], np.where(same, of - good, -good).cumsum()])
    low = np.minimum.accumulate(total)  # non-increasing: for each end, the first start whose sum is not above it
    start = len(low) - np.searchsorted(low[::-1], total, "right")
    size = np.arange(len(total)) - start
    end = int(size.argmax())
    n = int(size[end])
    if n < LEAST:
        return None
    return lo + end - n, n, int(same[end - n : end].sum())


def found(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, h (xxhash64 of the text), item_id, b (n_words, n_equal, word: minus the first word): the overlaps of each
    text and item, the best of each region."""
    spark = docs.sparkSession
    own = written(_items(items, text, item_id), work_dir(spark, "items"))
    bodies = own.groupBy("item").agg(F.first("body").alias("item_body"), F.max("n").alias("n"))
    seed = written(_item_seeds(bodies.select("item", F.col("item_body").alias("body"))), work_dir(spark, "seeds"))
    short = tuple(sorted(r["n"] for r in own.where(F.col("n") < LEAST).select("n").distinct().collect()))  # at most LEAST - 1
    reach = own.agg(F.max("n")).first()[0] or 0
    sent = spark.sparkContext.broadcast(bitmap.build(seed.select("h")))
    near = written(_regions(docs, text, doc_id, sent, short, reach), work_dir(spark, "regions"))
    regions = near.groupBy("region").agg(F.first("body").alias("body"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, region, at = [], [], []
            for key, body in zip(b.column("region").to_pylist(), b.column("body").to_pylist(), strict=True):
                for x, _ in seeds(_words(body), short):
                    k = np.flatnonzero(bitmap.hits(sent.value, x))
                    h.append(x[k].view(np.int64))
                    region += [key] * len(k)
                    at.append(k)
            numbers = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (h, at)]
            yield pa.RecordBatch.from_arrays([numbers[0], pa.array(region, pa.binary()), numbers[1]], names=["h", "region", "at"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for region, item, shift, x, y in zip(*(b.column(c).to_pylist() for c in ("region", "item", "shift", "body", "item_body")), strict=True):
                if o := overlap(_words(x), _words(y), shift):
                    rows.append((region, item, *o))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k < 2 else pa.int64()) for k in range(5)], names=["region", "item", "word", "n_words", "n_equal"])

    hits = regions.mapInArrow(again, "h long, region binary, at long")
    pairs = hits.join(seed, "h").select("region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    checked = pairs.join(regions, "region").join(bodies.select("item", "item_body"), "item").mapInArrow(verify, "region binary, item binary, word long, n_words long, n_equal long")
    best = checked.groupBy("region", "item").agg(F.max(F.struct("n_words", "n_equal", (-F.col("word")).alias("word"))).alias("b"))
    out = best.join(near.select("region", "doc_id", "h", "at"), "region").join(own.select("item", "item_id"), "item")
    return out.select("doc_id", "h", "item_id", F.struct("b.n_words", "b.n_equal", (F.col("b.word") - F.col("at")).alias("word")).alias("b"))


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_words and n_equal of the longest overlap, doc_word: where it starts. One row a pair of ids."""
    out = found(docs, items, text, doc_id, item_id).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return out.select("doc_id", "item_id", "b.n_words", "b.n_equal", (-F.col("b.word")).alias("doc_word"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text overlaps an item of the benchmark; another text with the same doc_id stays."""
    bad = found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("bad_id"), F.col("h").alias("bad_h")).distinct()
    bad = written(bad, work_dir(spark, "bad"))  # its size is known then, and docs stay where they are while it is small
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_h"]), "left_anti")

"""A quality classifier: a factorisation machine over hashed words, structure statistics of the text and n_chars.

A text's score is the logistic of  bias + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j  with a vector of FACTORS numbers
for each of 2**BITS hashed features. Pairs are never listed: by factor, their sum is half of the square of the sum of
v_i x_i less the sum of their squares, so a score takes time in proportion to the features that a text has.

Fitting takes a bounded sample: the SAMPLE labelled documents of least hash (of those that may be learned from), and of
their features, in that order, ENTRIES at most, in one task; AdaGrad in fixed batches and order, so reruns agree. Features
are extracted, and all texts scored, in parallel; the model is 4 * (1 + FACTORS) bytes a feature, 2.4 MB, at any size.

Labels, lang, source and doc_id are no features. A document is held out if the CRC-32 of its doc_id as text leaves HELD_OUT
modulo FOLDS.

Defined cases: a null text is empty, and an empty one is scored by its structure features; a null n_chars, or a table
without that column, is a feature of its own; a null doc_id counts as empty text in the checksum; labels other than 0 and
1 are ignored, and repeated ones count as often as they occur; of rows that share a doc_id one is learned from, and all are
scored; without labels every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.shared import work_dir, written
from verdigris.llm.text import U, bounds, flat, mix, slices, windows, word_hashes

BITS, FACTORS, SAMPLE, ENTRIES = 16, 8, 8192, 8_000_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.1, 1e-4, 20

#: Kinds of bytes whose share of a text is a statistic of its structure.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>@^~=+_{}[]\\/", "stop": b".,;:!?", "line": b"\n"}
_OF_KIND = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in KINDS.items()}


@dataclass
class Features:
    """Of rows of texts: sorted by row, each feature's row, number and value."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rows: int


def _index(name: int, bucket: np.ndarray) -> np.ndarray:
    """The hashed feature of each bucket of a named statistic."""
    return (mix(bucket.astype(np.int64).view(U) + mix(np.array([name], U))) >> U(64 - BITS)).astype(np.int64)


def _per_row(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def _unlike(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many different hashes it has, and how many hashes that occur twice or more, each time counted."""
    order = np.lexsort((h, row))
    r, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    many = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]]))
    return np.bincount(r[new], minlength=rows), np.bincount(r[new], weights=np.where(many > 1, many, 0), minlength=rows)


def features(texts: pa.Array, n_chars: np.ndarray) -> Features:
    """n_chars: -1 where missing."""
    data, offsets = flat(texts)
    starts, ends, first = bounds(data, offsets)
    h, rows, words = word_hashes(data, starts, ends), len(offsets) - 1, np.diff(first)
    row = np.repeat(np.arange(rows), words)
    tokens, n = np.unique(row << BITS | (mix(h) >> U(64 - BITS)).astype(np.int64), return_counts=True)
    weight = 1 + np.log(n)
    norm = np.sqrt(np.bincount(tokens >> BITS, weights=weight**2, minlength=rows))
    size = np.diff(offsets)
    points = _per_row(offsets, (data & 0xC0) != 0x80)
    some = np.maximum(words, 1)
    grams = windows(h, 3)
    inside = row[:-2] == row[2:] if len(h) > 2 else np.zeros(0, bool)
    different, _ = _unlike(row, h, rows)
    _, again = _unlike(row[: len(grams)][inside], grams[inside], rows)
    shares = [_per_row(offsets, _OF_KIND[k][data]) / np.maximum(size, 1) for k in KINDS]
    shares += [_per_row(offsets, data >= 0x80) / np.maximum(size, 1), _per_row(offsets, _OF_KIND["symbol"][data]) / some, different / some, again / some]
    log2 = lambda x: np.floor(np.log2(x + 1.0))
    sizes = [log2(words), log2(_per_row(offsets, data == 10)), np.minimum(40, np.floor(2 * points / some)), np.where(n_chars < 0, -1, log2(np.maximum(n_chars, 0))), np.sign(n_chars - points)]
    at = np.arange(rows)
    parts = [(tokens >> BITS, tokens & ((1 << BITS) - 1), weight / norm[tokens >> BITS])]
    for k, s in enumerate(shares):
        parts += [(at, _index(2 * k + 1, np.floor(np.minimum(s, 4) * 20)), np.full(rows, 0.5)), (at, _index(2 * k + 2, np.zeros(rows)), np.minimum(s, 4))]
    parts += [(at, _index(100 + k, s), np.full(rows, 0.5)) for k, s in enumerate(sizes)]
    row, index, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return Features(row[order], index[order], value[order].astype(np.float64), rows)


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float = 0.0, linear: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.linear = np.zeros(1 << BITS, np.float32) if linear is None else linear
        self.factors = np.zeros((1 << BITS, FACTORS), np.float32) if factors is None else factors

    def sums(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """For each row its value before the logistic, and by factor the sum of v_i x_i."""
        total = self.bias + np.bincount(f.row, weights=self.linear[f.index] * f.value, minlength=f.rows)
        by = np.empty((f.rows, FACTORS))
        for k in range(FACTORS):
            x = self.factors[f.index, k] * f.value
            by[:, k] = np.bincount(f.row, weights=x, minlength=f.rows)
            total += 0.5 * (by[:, k] ** 2 - np.bincount(f.row, weights=x * x, minlength=f.rows))
        return total, by

    def score(self, f: Features) -> np.ndarray:
        return logistic(self.sums(f)[0])

    def gradient(self, f: Features, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean logistic loss: for the bias, and for each feature that occurs its number, weight and factors."""
        total, by = self.sums(f)
        d = (logistic(total) - label) / f.rows
        seen, of = np.unique(f.index, return_inverse=True)
        dx = d[f.row] * f.value
        v = np.empty((len(seen), FACTORS))
        for k in range(FACTORS):
            v[:, k] = np.bincount(of, weights=dx * (by[f.row, k] - self.factors[f.index, k] * f.value), minlength=len(seen))
        return float(d.sum()), seen, np.bincount(of, weights=dx, minlength=len(seen)), v

    def saved(self) -> bytes:
        return np.concatenate([[np.float32(self.bias)], self.linear, self.factors.ravel()]).astype("<f4").tobytes()

    @classmethod
    def loaded(cls, raw: bytes) -> Machine:
        x = np.frombuffer(raw, "<f4")
        return cls(float(x[0]), x[1 : 1 + (1 << BITS)], x[1 + (1 << BITS) :].reshape(1 << BITS, FACTORS))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _taken(f: Features, rows: np.ndarray) -> Features:
    """The features of the rows, numbered anew in the order given."""
    first = np.searchsorted(f.row, np.arange(f.rows + 1))
    n = first[rows + 1] - first[rows]
    at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return Features(np.repeat(np.arange(len(rows)), n), f.index[at], f.value[at], len(rows))


def fitted(f: Features, label: np.ndarray) -> Machine:
    """AdaGrad over shuffled batches, the same ones each time."""
    m = Machine()
    if not f.rows:
        return m
    r = np.random.default_rng(SEED)
    share = (label.sum() + 1) / (f.rows + 2)
    m.bias = float(np.log(share / (1 - share)))
    m.factors = r.normal(0, 0.02, m.factors.shape).astype(np.float32)
    m.factors[np.setdiff1d(np.arange(1 << BITS), f.index)] = 0  # what was never seen adds nothing
    g0, g1, g2 = 1e-6, np.full(1 << BITS, 1e-6), np.full(m.factors.shape, 1e-6)
    for _ in range(EPOCHS):
        order = r.permutation(f.rows)
        for at in range(0, f.rows, BATCH):
            rows = order[at : at + BATCH]
            b, seen, w, v = m.gradient(_taken(f, rows), label[rows])
            w, v = w + DECAY * m.linear[seen], v + DECAY * m.factors[seen]
            g0, g1[seen], g2[seen] = g0 + b * b, g1[seen] + w * w, g2[seen] + v * v
            m.bias -= RATE * b / g0**0.5
            m.linear[seen] -= RATE * w / np.sqrt(g1[seen])
            m.factors[seen] -= 0.5 * RATE * v / np.sqrt(g2[seen])
    return m


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _slim(docs: DataFrame) -> DataFrame:
    chars = F.coalesce(F.col("`n_chars`").cast("bigint"), F.lit(-1)) if "n_chars" in docs.columns else F.lit(-1).cast("bigint")
    return docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"), chars.alias("n_chars"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Machine:
    """Fitted to labels (doc_id, quality) that are not held out."""
    spark = docs.sparkSession
    own = labels.select(F.col("`doc_id`").cast("bigint").alias("of"), F.col("`quality`").cast("int").alias("label")).where("label in (0, 1)").where(fold(F.col("of")) != HELD_OUT)
    own = own.withColumn("h", F.xxhash64("of")).orderBy("h", "of", "label").limit(sample)
    own = written(own, work_dir(spark, "labelled"))
    ids = own.select("of").distinct()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = features(b.column("text"), b.column("n_chars").to_numpy())
            at = pa.array(np.searchsorted(f.row, np.arange(f.rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(f.index.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(f.value))], names=["doc_id", "i", "x"])

    given = _slim(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("of"), "left_semi")  # `sample` ids at most
    found = given.mapInArrow(extract, "doc_id long, i array<int>, x array<double>").groupBy("doc_id").agg(F.min(F.struct("i", "x")).alias("f"))
    rows = own.join(found, F.col("of") == F.col("doc_id")).select("h", "of", "label", "f.i", "f.x")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, size, index, value, room = [], [], [], [], entries
        for b in batches:
            n = np.diff(b.column("i").offsets.to_numpy())
            keep = int(np.searchsorted(np.cumsum(n), room, "right"))
            room -= int(n[:keep].sum())
            part = b.slice(0, keep)
            label.append(part.column("label").to_numpy()), size.append(n[:keep]), index.append(part.column("i").flatten().to_numpy()), value.append(part.column("x").flatten().to_numpy())
            if keep < b.num_rows:
                break
        size, label = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (size, label))
        f = Features(np.repeat(np.arange(len(size)), size), np.concatenate([np.zeros(0, np.int64), *index]), np.concatenate([np.zeros(0), *value]), len(size))
        yield pa.RecordBatch.from_arrays([pa.array([fitted(f, label).saved()], pa.binary())], names=["model"])

    first = rows.repartition(1).sortWithinPartitions("h", "of", "label").mapInArrow(fit, "model binary").first()
    return Machine.loaded(bytes(first[0])) if first else Machine()


def scored(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each of docs."""
    model = docs.sparkSession.sparkContext.broadcast(machine.saved())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.loaded(model.value)
        for b in slices(batches):
            s = m.score(features(b.column("text"), b.column("n_chars").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    s = _slim(docs).mapInArrow(score, "doc_id long, score double")
    return s.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, trained(docs, labels))

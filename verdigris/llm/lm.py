"""An interpolated modified Kneser-Ney bigram model.

Counting: tasks sum their own words and bigrams and send sorted, compressed arrays, one for each range of word hashes;
one reader for each range merges them. Model files, in one folder that all machines mount, each a plain array that
workers map into memory: for range r `hash.r` (its words' hashes, sorted: a word's id is its place in all ranges),
`count.r`, `cont.r` (different words before it), `pair.r` (bigrams that begin with its words: place in the range and id of
the second word, sorted), `pairs.r` (their counts), `total.r` and `back.r` (of each first word: its count as a context and
the weight it leaves to the lower order). Files are written aside and renamed, so a repeated task leaves the same file.

    p(w | v) = max(c(vw) - D, 0) / c(v.) + back(v) * p(w)        D by c(vw): 1, 2, 3 or more
    p(w)     = max(n(.w) - D, 0) / n(..) + left / (V + 1)         D by n(.w), the number of different words before w

The two orders' discounts follow from their counts of counts (Chen and Goodman, 1998). An unknown word has the share of
one more word; an unknown first word leaves all to the lower order. Text begins with a mark that is only a context, and
ends with an end token that is scored.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the empty text for held_out's
checksum; repeated rows count as often as they occur; without training rows every word is unknown; other columns are
ignored. A-Z count as a-z. 2**32 different words or more are refused, as ids in files have 32 bits.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.shared import posix, work_dir, written
from verdigris.llm.text import U, hashed, slices

FOLDS, HELD = 7, 2
#: Different words or bigrams that a task sums before it sends them on.
ENTRIES = 4_000_000
#: Bytes of training text for each range of hashes, at most (there are as many ranges as shuffle partitions at least): what
#: one reader merges grows with neither the corpus nor that setting.
RANGE_BYTES = 256 << 20


def is_held(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


class Sums:
    """Counts by key; parts are merged when they have doubled."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = self.base = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > 2 * self.base + 1_000_000:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        k, c = self.parts[0] if self.parts else (np.zeros(0, U), np.zeros(0, np.int64))
        self.n = self.base = len(k)
        return k, c


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted keys, and counts, byte by byte plane, compressed."""
    gaps = np.diff(keys, prepend=keys[:1] * U(0)).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    more = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes() + more.tobytes(), 1)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(16, -1)
    both = [np.ascontiguousarray(raw[k : k + 8].T).view("<u8")[:, 0] for k in (0, 8)]
    return np.cumsum(both[0].astype(U), dtype=U), both[1].astype(np.int64)


def _save(path: str, array: np.ndarray) -> None:
    aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(aside, "wb") as f:
        np.save(f, array)
    os.replace(aside, path)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of one value begin and end."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return at, np.append(at[1:], len(values))


def _sent(ranges: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each range; keys are sorted by range first."""
    at, ends = _stretches(ranges)
    return pa.RecordBatch.from_arrays([pa.array(ranges[at].astype(np.int32)), pa.array([packed(keys[a:z], counts[a:z]) for a, z in zip(at, ends, strict=True)], pa.binary())], names=["r", "body"])


_SENT = "r int, body binary"


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Sums]]:
    """The sums of each range, one after the other; rows are sorted by r."""
    r, sums = None, Sums()
    for b in batches:
        for k, body in zip(b.column("r").to_pylist(), b.column("body").to_pylist(), strict=True):
            if k != r:
                if r is not None:
                    yield r, sums
                r, sums = k, Sums()
            sums.add(*unpacked(body))
    if r is not None:
        yield r, sums


def _gathered(sent: DataFrame, ranges: int, reduce, schema: str) -> DataFrame:
    return sent.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(reduce, schema)


class Model:
    """The model's files, mapped when first needed. sizes: words in each range; END and BEGIN are ids after all words."""

    def __init__(self, path: str, sizes: list[int], numbers: dict | None = None):
        self.path, self.first, self.numbers = path, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), numbers or {}
        self.n_words = int(self.first[-1])
        self.end, self.begin = self.n_words, self.n_words + 1
        self.open: dict[str, np.ndarray] = {}

    def file(self, name: str, r: int) -> np.ndarray:
        key = f"{name}.{r}"
        if key not in self.open:
            self.open[key] = np.load(f"{self.path}/{key}", mmap_mode="r")
        return self.open[key]

    def range_of_id(self, ids: np.ndarray) -> np.ndarray:
        """END and BEGIN belong to the last range."""
        return np.minimum(np.searchsorted(self.first, ids, "right") - 1, len(self.first) - 2)

    def _each(self, ranges: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of one range in a sorted array of ranges."""
        at, ends = _stretches(ranges)
        for a, z in zip(at.tolist(), ends.tolist(), strict=True):
            yield int(ranges[a]), slice(a, z)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Of sorted hashes; -1 where the word is unknown."""
        out = np.full(len(h), -1, np.int64)
        for r, s in self._each(_range_of(h, len(self.first) - 1)):
            known = self.file("hash", r)
            if len(known):
                at = np.searchsorted(known, h[s])
                hit = known[np.minimum(at, len(known) - 1)] == h[s]
                out[s] = np.where(hit, at + self.first[r], -1)
        return out

    def values(self, name: str, ids: np.ndarray, missing: float = 0) -> np.ndarray:
        """Of sorted ids, the array's values; the last range's arrays hold END (and BEGIN) after its words."""
        out = np.full(len(ids), missing, np.float64)
        known = np.searchsorted(ids, 0)
        for r, s in self._each(self.range_of_id(ids[known:])):
            s = slice(s.start + known, s.stop + known)
            out[s] = self.file(name, r)[ids[s] - self.first[r]]
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of pairs of ids sorted by v and w; 0 where unknown."""
        out = np.zeros(len(v), np.int64)
        for r, s in self._each(self.range_of_id(v)):
            keys = self.file("pair", r)
            if len(keys):
                q = ((v[s] - self.first[r]).astype(U) << U(40)) | w[s].astype(U)
                at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                out[s] = np.where(keys[at] == q, self.file("pairs", r)[at], 0)
        return out


def _words(b: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all tokens with the end tokens (-1: unknown), the ids before them, and the tokens' first places by text."""
    h, first = hashed(b.column("text"))
    u, _ = summed(h)
    ids = model.ids(u)[np.searchsorted(u, h)] if len(h) else np.zeros(0, np.int64)
    w = np.insert(ids, first[1:], model.end)
    first = first + np.arange(len(first))
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first[:-1]] = model.begin
    return w, v, first


def discounts(n: list[int]) -> list[float]:
    """D for counts of 1, 2, and 3 or more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _d(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def train(docs: DataFrame, path: str | None = None, text: str = "text") -> Model:
    """Counts the texts of docs and writes the model's files to path, a folder that every machine mounts."""
    spark = docs.sparkSession
    path = path or posix(work_dir(spark, "lm"))
    os.makedirs(path, exist_ok=True)
    given = docs.select(F.col(text).alias("text"))
    counted = given.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_docs = counted["docs"]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(counted["bytes"] or 0) // RANGE_BYTES))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in slices(batches):
            sums.add(*summed(hashed(b.column("text"))[0]))
            if sums.base > ENTRIES:
                k, c = sums.merged()
                yield _sent(_range_of(k, ranges), k, c)
                sums = Sums()
        k, c = sums.merged()
        yield _sent(_range_of(k, ranges), k, c)

    def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, sums in _by_range(batches):
            k, c = sums.merged()
            _save(f"{path}/hash.{r}", k)
            _save(f"{path}/count.{r}", c)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["r", "n", "total"])

    found = {r["r"]: r for r in _gathered(given.mapInArrow(count_words, _SENT), ranges, keep_words, "r int, n long, total long").collect()}
    for r in set(range(ranges)) - set(found):
        _save(f"{path}/hash.{r}", np.zeros(0, U))
        _save(f"{path}/count.{r}", np.zeros(0, np.int64))
    model = Model(path, [found[r]["n"] if r in found else 0 for r in range(ranges)])
    last = ranges - 1
    old = np.load(f"{path}/count.{last}")
    _save(f"{path}/count.{last}", np.append(old[: model.first[-1] - model.first[-2]], n_docs))
    n_tokens = sum(r["total"] for r in found.values()) + n_docs

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = Model(path, np.diff(model.first).tolist()), Sums()

        def out():
            k, c = sums.merged()
            v = (k >> U(32)).astype(np.int64)
            r = m.range_of_id(v)
            local = ((v - m.first[r]).astype(U) << U(40)) | (k & U(0xFFFFFFFF))
            return _sent(r, local, c)

        for b in slices(batches):
            w, v, _ = _words(b, m)
            sums.add(*summed((v.astype(U) << U(32)) | w.astype(U)))
            if sums.base > ENTRIES:
                yield out()
                sums = Sums()
        yield out()

    def keep_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a range's pairs; returns for each range of second words how many different words stand before them,
        and, with r = -1, how many pairs have counts 1 to 4."""
        for r, sums in _by_range(batches):
            k, c = sums.merged()
            _save(f"{path}/pair.{r}", k)
            _save(f"{path}/pairs.{r}", c.astype(np.uint32 if not len(c) or c.max() < 1 << 32 else np.int64))
            w, n = summed(k & U((1 << 40) - 1))
            yield _sent(model.range_of_id(w.astype(np.int64)), w, n)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([packed(np.arange(5, dtype=U), np.array([len(k), *(int((c == i).sum()) for i in range(1, 5))], np.int64))], pa.binary())], names=["r", "body"])

    if model.begin >= 1 << 32:
        raise ValueError("more than 2**32 different words")
    sent = written(_gathered(given.mapInArrow(count_pairs, _SENT), ranges, keep_pairs, _SENT), work_dir(spark, "lm-pairs"))
    of_pairs = sum((unpacked(bytes(r["body"]))[1] for r in sent.where("r = -1").select("body").toLocalIterator()), np.zeros(5, np.int64))
    d2 = discounts(of_pairs[1:].tolist())

    def keep_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes for each word of a range the number of different words before it; returns counts of counts."""
        for r, sums in _by_range(batches):
            k, c = sums.merged()
            out = np.zeros(model.first[r + 1] - model.first[r] + (r == last), np.int64)
            out[k.astype(np.int64) - model.first[r]] = c
            _save(f"{path}/cont.{r}", out)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([int((c == i).sum())], pa.int64()) for i in range(1, 5)), pa.array([int((c > 2).sum())], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["r", "n1", "n2", "n3", "n4", "more", "total"])

    def keep_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes for each first word of a range its total and what its discounts leave to the lower order."""
        for b in batches:
            for r in b.column("r").to_pylist():
                k, c = np.load(f"{path}/pair.{r}"), np.load(f"{path}/pairs.{r}").astype(np.int64)
                n = int(model.first[r + 1] - model.first[r]) + 2 * (r == last)
                v = (k >> U(40)).astype(np.int64)
                total = np.bincount(v, c, n)
                back = np.bincount(v, _d(c, d2), n) / np.maximum(total, 1)
                _save(f"{path}/total.{r}", total)
                _save(f"{path}/back.{r}", np.where(total > 0, back, 1.0))
                yield pa.RecordBatch.from_arrays([b.column("r").slice(0, 1)], names=["r"])

    rows = _gathered(sent.where("r >= 0"), ranges, keep_before, "r int, n1 long, n2 long, n3 long, n4 long, more long, total long").collect()
    done = {r["r"] for r in rows}
    for r in range(ranges):
        if r not in done:
            _save(f"{path}/cont.{r}", np.zeros(model.first[r + 1] - model.first[r] + (r == last), np.int64))
        for name, kind in (("pair", U), ("pairs", np.uint32)):
            if not os.path.exists(f"{path}/{name}.{r}"):
                _save(f"{path}/{name}.{r}", np.zeros(0, kind))
    spark.range(ranges).selectExpr("cast(id as int) r").repartition(ranges, "r").mapInArrow(keep_contexts, "r int").count()
    n = [sum(r[f"n{i}"] for r in rows) for i in range(1, 5)]
    d1, total = discounts(n), sum(r["total"] for r in rows)
    left = (d1[0] * n[0] + d1[1] * n[1] + d1[2] * sum(r["more"] for r in rows)) / total if total else 1.0
    model.numbers = {"tokens": n_tokens, "types": model.n_words + (n_docs > 0), "pairs": total, "d1": d1, "d2": d2, "left": left}
    model.open = {}
    return model


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each text."""
    path, sizes, x = model.path, np.diff(model.first).tolist(), model.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(path, sizes)
        for b in slices(batches):
            w, v, first = _words(b, m)
            u, _ = summed(w)
            count, cont = m.values("count", u), m.values("cont", u)
            low = np.maximum(cont - _d(cont, x["d1"]), 0) / max(x["pairs"], 1) + x["left"] / (x["types"] + 1)
            at = np.searchsorted(u, w)
            pair, _ = summed((np.maximum(v + 1, 0).astype(U) << U(32)) | (w + 1).astype(U))
            pv, pw = (pair >> U(32)).astype(np.int64) - 1, (pair & U(0xFFFFFFFF)).astype(np.int64) - 1
            both = np.flatnonzero((pv >= 0) & (pw >= 0))
            c = np.zeros(len(pair), np.int64)
            c[both] = m.pair_counts(pv[both], pw[both])
            total, back = m.values("total", pv), m.values("back", pv, 1.0)
            p = np.maximum(c - _d(c, x["d2"]), 0) / np.maximum(total, 1) + back * low[np.searchsorted(u, pw)]
            logs = np.log10(p)[np.searchsorted(pair, (np.maximum(v + 1, 0).astype(U) << U(32)) | (w + 1).astype(U))]
            base = np.log10((count + 1) / (x["tokens"] + x["types"] + 1))[at]
            add = lambda a: np.add.reduceat(a, first[:-1])  # noqa: E731  every text has a token
            n = np.diff(first)
            s = add(logs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(add((count[at] > 0).astype(np.int64))), pa.array(np.full(len(n), x["tokens"], np.int64)), pa.array(add(base)), pa.array(s), pa.array(10.0 ** np.minimum(-s / n, 300.0))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), is_held(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def trained_and_scored(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs.where(~is_held(F.col("doc_id")))))

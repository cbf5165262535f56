"""Exact Jaccard self-join on word shingles by partitioning the universe.

Two sets of sizes s <= r with Jaccard similarity of at least num/den differ in at most H = (den - num) * (s + r) div
(den + num) shingles. Sizes are dealt into bands so that linked sets lie in one band or two neighbouring ones. For each
pair of bands the universe of shingles is hashed into segments; a segment matched exactly absorbs no difference, one
matched by a one-deletion neighbourhood absorbs one. With a capacity of H + 1, linked sets agree in a segment's signature
(the pigeonhole principle). `allocate` picks, by estimated cost, between many exact segments and fewer one-deletion ones,
and how many spare segments to add so that agreement of empty segments alone need not be indexed.

Sets that share a signature fall into the group of the bucket's first member, its pivot. Sizes and parity sketches, which
never hide a link, come first: each set is compared exactly with one pivot that they do not rule out, and these links
already join most near copies. Groups that still hold several components are then searched by sketches, in blocks of
bounded size, for sets that may link across components; only those sets are fetched and compared exactly, and never with
what they are connected to already. Copies of one set are one class throughout and are not compared: a class is known by a
64-bit hash, and by a second one where the table holds two sets with the same first.

A signature that many sets of a task have in common is hot: its rows are dealt by the set too, and only the smallest and
the largest of each task stand for them where the bucket's pivot is found.

Defined cases: A-Z count as a-z; a null, empty or blank text has no shingles and links with nothing; a text with fewer
words than a shingle has one shingle, all its words; a null doc_id takes part, and is never the smallest where another
is there; repeated rows are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm import bitmap
from verdigris.llm.components import components
from verdigris.llm.shared import release, remove, work_dir, written
from verdigris.llm.text import U, hashed, mix, slices, windows

#: Bits of a sketch at least. A group's blocks: of at least these bytes of sketches and of sets, then a number at most,
#: and above all no more bytes than a task holds.
SKETCH_BITS, SKETCH_BLOCK, SET_BLOCK, BLOCKS, BLOCK_BYTES = 512, 1 << 15, 1 << 18, 48, 1 << 23
#: Rows of signatures that a task looks through for hot ones, how many sets make one hot, and to how many parts it is dealt.
ROWS, HOT, SALTS = 400_000, 32, 64
#: For the cost alone: the chance that an unrelated set holds a given shingle of several words; high for prose.
SHARED = 0.001
#: Classes a task remembers so as to emit them once; beyond, it starts anew and only repeats some rows.
SEEN = 1_000_000


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its different shingles' hashes, sorted."""
    h, first = hashed(texts)
    w = windows(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(w[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(windows(h[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def class_of(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of the set, as signed numbers; copies of a set agree in both. bits: of the first, fewer in tests."""
    first, second = (mix(mix(s ^ U(x)).sum(dtype=U, keepdims=True) + U(len(s))) for x in (0, 0x6A09E667F3BCC908))
    return int((first >> U(64 - bits)).view(np.int64)[0]), int(second.view(np.int64)[0])


def above(mean: float, n: int) -> float:
    """A bound for the chance that a Poisson variable exceeds n (Chernoff)."""
    x = n + 1
    return 1.0 if x <= mean else math.exp(-mean + x - x * math.log(x / mean)) if mean else 0.0


class Plan:
    """Bands, and for each pair of neighbouring bands how its segments are matched."""

    def __init__(self, num: int, den: int, n_sets: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * den // num + 1))
        self.kept: dict[int, tuple[int, int, int]] = {}
        self.n_sets = n_sets

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1

    def groups(self, size: int) -> list[int]:
        """A set takes part in the group of its own band, and in that of the band below if sets there can reach it."""
        j = self.band(size)
        return [j, j - 1] if j and size <= (self.low[j] - 1) * self.den // self.num else [j]

    def differences(self, j: int) -> int:
        s = self.low[j + 1] - 1
        return (self.den - self.num) * (s + s * self.den // self.num) // (self.den + self.num)

    def allocate(self, j: int) -> tuple[int, int, int]:
        """Numbers of exact segments, of one-deletion segments, and of spare ones among them: the cheapest of a few."""
        if j not in self.kept:
            need, size, best = self.differences(j) + 1, self.low[j], None
            for spare in dict.fromkeys((0, 1, 2, 3, *(max(4, need * x // 32) for x in range(1, 13)))):
                for exact, deletions in ((need + spare, 0), (0, -(-(need + 2 * spare) // 2))):
                    m = exact + deletions
                    k = size / m
                    chance = lambda x: self.n_sets * SHARED ** max(x, 0)
                    empty = m * math.exp(-k) * (1 + (k if deletions else 0))
                    more = above(empty, spare)
                    cost = exact * (1 + chance(k)) + deletions * (1 + k) * (1 + chance(k - 1)) + max(0.0, more) * self.n_sets
                    if best is None or cost < best[0]:
                        best = (cost, exact, deletions, spare)
            self.kept[j] = best[1:]
        return self.kept[j]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        out = []
        m_of = mix(s ^ U(0xA5A5A5A5A5A5A5A5))
        total = np.zeros(len(s) + 1, U)
        np.cumsum(m_of, out=total[1:])
        for j in self.groups(len(s)):
            exact, deletions, spare = self.allocate(j)
            m = exact + deletions
            ends = np.searchsorted(s, np.array([(i << 64) // m for i in range(1, m)], U)) if m > 1 else np.zeros(0, np.int64)
            ends = np.concatenate([[0], ends, [len(s)]])
            value, count = total[ends[1:]] - total[ends[:-1]], np.diff(ends)
            salt = mix(np.arange(m, dtype=U) + U((j + 1) << 32))
            trivial = np.flatnonzero(count <= (deletions > 0))
            keep = count > 0 if len(trivial) <= spare else np.ones(m, bool)
            out.append(mix(value[keep] ^ salt[keep]))
            if deletions:
                seg = np.repeat(np.arange(m), count)
                less = (value[seg] - m_of) ^ salt[seg]
                out.append(mix(less[(count[seg] > 1) | (len(trivial) > spare)]))
        return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def sketch(s: np.ndarray, bits: int = 0) -> np.ndarray:
    """Parities of the elements' numbers by bits: two sketches differ in no more bits than their sets do in elements.
    Without bits, a power of two of at least SKETCH_BITS and twice the set's size."""
    bits = bits or max(SKETCH_BITS, 1 << int(2 * len(s) - 1).bit_length())
    n = np.bincount((mix(s + U(77)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(n.astype(np.uint8), bitorder="little").view(U)


def folded(sk: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer bits, which still never differs more than the sets: halves are added bit by bit."""
    while len(sk) > words:
        sk = sk[: len(sk) // 2] ^ sk[len(sk) // 2 :]
    return sk


class Sketched:
    """Sets by size and sketch: which of them may link."""

    def __init__(self, n: list[int], sk: list[np.ndarray], num: int, den: int):
        self.n, self.sk, self.num, self.den = np.array(n), sk, num, den
        words = min(map(len, sk))
        self.short = np.stack([folded(x, words) for x in sk])

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Of the sets in rest those that size and sketch do not rule out as links of set i: by short sketches for all,
        then by those as long as the two sets allow."""
        n = self.n
        rest = rest[np.minimum(n[rest], n[i]) * self.den >= np.maximum(n[rest], n[i]) * self.num]
        most = (self.den - self.num) * (n[rest] + n[i]) // (self.den + self.num)
        ok = np.bitwise_count(self.short[rest] ^ self.short[i]).sum(axis=1) <= most
        rest, most = rest[ok], most[ok]
        apart = np.empty(len(rest), np.int64)
        for k, j in enumerate(rest.tolist()):
            words = min(len(self.sk[i]), len(self.sk[j]))
            apart[k] = np.bitwise_count(folded(self.sk[i], words) ^ folded(self.sk[j], words)).sum()
        return rest[apart <= most]


def block_near(labels: list[int], sides: list[int], sets: Sketched) -> np.ndarray:
    """Numbers of the sets of a block that may link with one of another label (and side, if there are two)."""
    label, side = np.unique(labels, return_inverse=True)[1], np.array(sides)
    one_side, hit = len(set(sides)) == 1, np.zeros(len(labels), bool)
    for i in range(len(labels) - 1):
        rest = np.arange(i + 1, len(labels))
        rest = rest[(label[rest] != label[i]) & (one_side | (side[rest] != side[i])) & ~(hit[rest] & hit[i])]
        if len(rest) and len(rest := sets.near(i, rest)):
            hit[rest] = hit[i] = True
    return np.flatnonzero(hit)


def block_links(ids: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links inside a block between different labels, until what is linked is connected; sides: only pairs of different
    sides count, unless all are on one."""
    by, out = Sketched([len(s) for s in sets], [sketch(s) for s in sets], num, den), []
    comp, side = np.unique(labels, return_inverse=True)[1], np.array(sides)
    one_side = len(set(sides)) == 1
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(comp[rest] != comp[i]) & (one_side | (side[rest] != side[i]))]
        for j in by.near(i, rest).tolist() if len(rest) else ():
            if comp[j] != comp[i] and linked(sets[i], sets[j], num, den):
                out.append((ids[i], ids[j]))
                comp[comp == comp[j]] = comp[i]
    return out


def _binary(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8").astype(U, copy=False)


def classes(docs: DataFrame, text: str, k: int, bits: int = 64) -> DataFrame:
    """doc_id, n (shingles), cls and chk (both null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), k)
            both = [class_of(s, bits) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in both], pa.int64()) for i in (0, 1))], names=["doc_id", "n", "cls", "chk"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, n long, cls long, chk long")


class Names:
    """One number for each class: its first hash, but for the classes that share it with another, all of which but one
    are numbered by both hashes. Nearly always there are none."""

    def __init__(self, slim: DataFrame):
        of = slim.where("cls is not null").groupBy("cls")
        twice = written(of.agg(F.min("chk").alias("low"), F.max("chk").alias("high")).where("low < high").select("cls", "low"), work_dir(slim.sparkSession, "clashes"))
        self.split = None
        if not twice.isEmpty():
            split = slim.join(twice, "cls").select("cls", "chk", F.when(F.col("chk") == F.col("low"), F.col("cls")).otherwise(F.xxhash64("cls", "chk")).alias("id")).distinct()
            self.split = written(split, work_dir(slim.sparkSession, "split"))

    def named(self, df: DataFrame) -> DataFrame:
        """df with the class's number as cls and without chk."""
        if self.split is None:
            return df.drop("chk")
        of = self.split.select(F.col("cls").alias("c2"), F.col("chk").alias("k2"), "id")
        return df.join(of, (F.col("cls") == F.col("c2")) & (F.col("chk") == F.col("k2")), "left").withColumn("cls", F.coalesce("id", "cls")).drop("chk", "c2", "k2", "id")

    def all_of(self, near: DataFrame) -> DataFrame:
        """near (cls, pivot: first hashes) with a row for each class that they may mean, and classes that share one."""
        if self.split is None:
            return near
        for c in ("cls", "pivot"):
            near = near.join(self.split.select(F.col("cls").alias(c), "id"), c, "left").withColumn(c, F.coalesce("id", c)).drop("id")
        return near.select("cls", "pivot").unionByName(self.split.select(F.col("id").alias("cls"), F.col("cls").alias("pivot"))).distinct()

    def hashes(self, wanted: DataFrame) -> DataFrame:
        """The first hashes of the classes in wanted (cls)."""
        if self.split is None:
            return wanted
        return wanted.join(self.split.select(F.col("id").alias("cls"), F.col("cls").alias("h")), "cls", "left").select(F.coalesce("h", "cls").alias("cls"))


def _hot_apart(sig: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """sig, cls, part: 0, but for signatures of HOT rows or more from 1 on by the class; these have two more rows, with
    their smallest and largest class and part -1."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(sig)))
    hot = np.flatnonzero(size >= HOT)
    part = np.where(np.repeat(size, size) >= HOT, 1 + (mix(cls.view(U)) % U(SALTS)).astype(np.int32), 0).astype(np.int32)
    ends = np.concatenate([at[hot], at[hot] + size[hot] - 1])
    whole = [np.concatenate(x) for x in ((sig, sig[ends]), (cls, cls[ends]), (part, np.full(len(ends), -1, np.int32)))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in whole], names=["sig", "cls", "part"])


def _near(given: DataFrame, plan: Plan, k: int, bits: int) -> DataFrame:
    """cls, pivot (the smallest class of a bucket) for each class of a bucket of two or more, by first hashes."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sig: list[np.ndarray] = []
        cls: list[np.ndarray] = []
        n = 0
        for b in slices(batches):
            for s in shingle_sets(b.column("text"), k):
                if len(s) and (c := class_of(s, bits)) not in seen:
                    seen.add(c)
                    x = plan.signatures(s).view(np.int64)
                    sig.append(x)
                    cls.append(np.full(len(x), c[0], np.int64))
                    n += len(x)
                    if n > ROWS:
                        yield _hot_apart(np.concatenate(sig), np.concatenate(cls))
                        sig, cls, n = [], [], 0
            if len(seen) > SEEN:
                seen = set()
        if sig:
            yield _hot_apart(np.concatenate(sig), np.concatenate(cls))

    bucket = Window.partitionBy("sig", F.greatest("part", F.lit(0)))
    rows = given.mapInArrow(index, "sig long, cls long, part int").select("sig", "cls", "part", F.min("cls").over(bucket).alias("pivot"), F.max("cls").over(bucket).alias("last"))
    rows = rows.where("part > 0 or pivot < last").groupBy("cls", "pivot", "part", F.when(F.col("part") != 0, F.col("sig")).alias("sig")).agg(F.lit(1).alias("x")).drop("x")
    rows = written(rows, work_dir(given.sparkSession, "buckets"))
    if rows.where("part <> 0").isEmpty():
        return rows.select("cls", "pivot")
    hot = rows.where("part > 0")
    pivots = rows.where("part = -1").select("sig", "pivot").distinct().join(hot.select("sig", "part").distinct(), "sig")
    dealt = hot.select("sig", "part", "cls").join(pivots, ["sig", "part"]).select("cls", "pivot")
    return written(rows.where("part <= 0").select("cls", "pivot").unionByName(dealt).distinct(), work_dir(given.sparkSession, "pivots"))


def links(docs: DataFrame, names: Names, n_docs: int, text: str, k: int, num: int, den: int, bits: int = 64) -> DataFrame:
    """a, b: links between classes that connect every two classes that links connect."""
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{text}`").alias("text"))
    near = _near(given, Plan(num, den, n_docs), k, bits)
    if names.split is not None:
        near = written(names.all_of(near), work_dir(spark, "pivots"))
    release(spark)

    def fetched(wanted: DataFrame, body, with_size: bool = False) -> DataFrame:
        return _fetched(given, names, wanted, k, body, with_size, bits)

    sketches = written(fetched(near.select("cls").union(near.select("pivot")), lambda s: sketch(s).tobytes(), True), work_dir(spark, "sketches"))

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n", "body", "n2", "body2")), strict=True)
            keep = [i for i, (n, x, n2, y) in enumerate(rows) if len(Sketched([n, n2], [np.frombuffer(x, U), np.frombuffer(y, U)], num, den).near(0, np.array([1])))]
            yield b.select(["cls", "pivot"]).take(pa.array(keep, pa.int64()))

    other = sketches.select(F.col("cls").alias("pivot"), F.col("n").alias("n2"), F.col("body").alias("body2"))
    pairs = near.where("cls <> pivot").join(sketches.hint("merge"), "cls").join(other.hint("merge"), "pivot")
    star = written(pairs.select("cls", "pivot", "n", "body", "n2", "body2").mapInArrow(plausible, "cls long, pivot long").groupBy("cls").agg(F.min("pivot").alias("pivot")), work_dir(spark, "star"))
    del pairs
    release(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (x, y) in enumerate(zip(b.column("body").to_pylist(), b.column("other").to_pylist(), strict=True)) if linked(_numbers(x), _numbers(y), num, den)]
            yield b.select(["cls", "pivot"]).take(pa.array(keep, pa.int64()))

    sets = written(fetched(star.select("cls").union(star.select("pivot")), _binary), path := work_dir(spark, "sets"), "lz4")
    pivots = sets.select(F.col("cls").alias("pivot"), F.col("body").alias("other"))
    first = written(star.join(sets, "cls").join(pivots, "pivot").select("cls", "pivot", "body", "other").mapInArrow(check, "cls long, pivot long"), work_dir(spark, "links"))
    del sets, pivots
    remove(spark, path)
    release(spark)
    root = components(first)
    labelled = near.join(root.select(F.col("node").alias("cls"), "root"), "cls", "left").select("pivot", "cls", F.coalesce("root", "cls").alias("label"))
    mixed = labelled.groupBy("pivot").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("pivot")
    mixed = written(mixed, work_dir(spark, "mixed"))  # apart from the join, which can then be split where a pivot is hot
    members = written(labelled.join(mixed, "pivot"), work_dir(spark, "members"))

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, ("cls", "label", "n", "body")):
            ids, labels, n, body = zip(*(r[1:] for r in rows), strict=True)
            hit = block_near(labels, [r[0] for r in rows], Sketched(n, [np.frombuffer(x, U) for x in body], num, den))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0].pivot] * len(hit), pa.int64()), pa.array([ids[i] for i in hit], pa.int64()), pa.array([labels[i] for i in hit], pa.int64())], names=["pivot", "cls", "label"])

    dealt = _dealt(members.join(sketches, "cls"), SKETCH_BLOCK)
    active = written(dealt.mapInArrow(may_link, "pivot long, cls long, label long").distinct(), work_dir(spark, "active"))
    sets = fetched(active.select("cls"), _binary)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, ("cls", "label", "body")):
            ids, labels, body = zip(*(r[1:] for r in rows), strict=True)
            one = block_links(ids, labels, [r[0] for r in rows], [_numbers(x) for x in body], num, den)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in one], pa.int64()), pa.array([y for _, y in one], pa.int64())], names=["cls", "pivot"])

    both = written(active.join(sets, "cls"), path := work_dir(spark, "both"), "lz4")
    second = written(_dealt(both, SET_BLOCK).mapInArrow(compare, "cls long, pivot long"), work_dir(spark, "links"))
    remove(spark, path)
    return first.union(second).select(F.col("cls").alias("a"), F.col("pivot").alias("b"))


def _fetched(given: DataFrame, names: Names, wanted: DataFrame, k: int, body, with_size: bool, bits: int) -> DataFrame:
    """cls, body (and n): of the texts' classes that wanted (one column) holds, each once."""
    wanted = wanted.toDF("cls")
    sent = given.sparkSession.sparkContext.broadcast(bitmap.build(names.hashes(wanted), bitmap.bits_for(wanted.count())))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), k)
            both = [class_of(s, bits) if len(s) else (0, 0) for s in sets]
            hit = bitmap.hits(sent.value, np.array([c for c, _ in both], np.int64).view(U))
            rows = []
            for s, c, ok in zip(sets, both, hit.tolist(), strict=True):
                if ok and len(s) and c not in seen:
                    seen.add(c)
                    rows.append((*c, len(s), body(s)))
            if len(seen) > SEEN:
                seen = set()
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=["cls", "chk", "n", "body"])

    own = names.named(given.mapInArrow(fetch, "cls long, chk long, n long, body binary"))
    own = own.groupBy("cls").agg(*([F.first("n").alias("n")] if with_size else []), F.first("body").alias("body"))
    return own.join(wanted.distinct(), "cls", "left_semi")


def _dealt(members: DataFrame, least: int) -> DataFrame:
    """members (pivot, cls, ..., body) dealt to blocks, as many as their group's bytes ask for, and each pair of a group's
    blocks to a task; rows of one pair (pivot, x, y) are neighbours. side: the block."""
    size = F.sum(F.length("body"))
    n = members.groupBy("pivot").agg(F.greatest(F.ceil(size / BLOCK_BYTES), F.least(F.ceil(size / least), F.lit(BLOCKS))).cast("int").alias("blocks"))
    large = written(n.where("blocks > 1"), work_dir(members.sparkSession, "large"))  # few: its size is known then
    dealt = members.join(large, "pivot", "left").fillna(1, ["blocks"]).withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("other", "blocks")
    return dealt.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y")


class _Row(tuple):
    pivot: int


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[_Row]]:
    """For each pair of blocks with two rows or more its rows: side and the columns; their attribute pivot is the group."""
    key, rows = None, []
    for b in batches:
        for p, x, y, *row in zip(*(b.column(c).to_pylist() for c in ("pivot", "x", "y", "side", *columns)), strict=True):
            if (p, x, y) != key:
                if len(rows) > 1:
                    yield rows
                key, rows = (p, x, y), []
            r = _Row(row)
            r.pivot = p
            rows.append(r)
    if len(rows) > 1:
        yield rows


def joined(docs: DataFrame, text: str = "text", k: int = 3, num: int = 90, den: int = 100, class_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach. class_bits: fewer make classes clash, which
    changes nothing but the work."""
    spark = docs.sparkSession
    slim = written(classes(docs, text, k, class_bits), work_dir(spark, "classes"))
    names = Names(slim)
    if names.split is not None:
        slim = written(names.named(slim), work_dir(spark, "named"))
    root = components(links(docs, names, slim.count(), text, k, num, den, class_bits))
    of = slim.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    of = of.join(root.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    of = of.select("cls", "root", "least")
    least = written(of.groupBy("root").agg(F.min("least").alias("component")), work_dir(spark, "least"))  # apart, so that a hot root's rows can be split
    of = of.join(least, "root")
    return slim.join(of.select("cls", "component"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 on five words: the one with the smallest doc_id; documents
    without words all stay. Of rows that agree in doc_id and text one stays; rows that share only a doc_id share its fate."""
    j = joined(docs, k=5, num=80)
    of = j.groupBy("doc_id").agg(F.bool_or((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    of = written(of.where("n > 1 or not stays").select(F.col("doc_id").alias("of_id"), "stays"), work_dir(spark, "gone"))
    own, again = docs["doc_id"].cast("bigint").eqNullSafe(of["of_id"]), of.where("stays")
    once = docs.join(of, own, "left_anti")
    return once if again.isEmpty() else once.unionByName(docs.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))

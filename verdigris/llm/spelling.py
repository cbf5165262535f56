"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form each goes back to.

Words are points of a plane: their rank in forward order and their rank in the order of their reversals. Those that differ
from a word at one position share what is before it, an interval of the forward order, and what is behind it, an interval
of the reverse order; a wavelet matrix reports the points in both. For words of k letters, those of k letters ask for a
replaced letter and those of k - 1 for an inserted one; a deleted letter is an inserted one seen from the other word.

Distribution: a word goes to the groups of words that agree with it outside a segment of positions; first the segments are
the two halves, so that one of them holds the edit. Groups are dealt to buckets of a bounded number of letters. A group
too large for one is dealt again by the halves of its segment, and so on: words that agree outside one position are no
more than there are letters, so this ends, with no pair lost and none found twice.

Defined cases: a null text has no runs; a null doc_id counts as an empty one in the hash; repeated rows count as often
as they occur; ties go to the word that is smallest in code-point order; the order of rows is of no account; an empty
table, or one without words that qualify, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.shared import remove, work_dir, written
from verdigris.llm.terms import covering, runs, strings
from verdigris.llm.text import LOWER, SHORT, flat, slices
from verdigris.llm.wavelet import Wavelet

LEAST_LETTERS, LEAST_COUNT, TIMES, NOISE = 7, 2, 10, 31
#: Letters in a bucket, about; buckets at least, so that small lexica are spread too; bytes of text counted together.
LETTERS, BUCKETS, SLICE = 1 << 20, 64, 4 << 20
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: The first of the two bytes of each code point from U+00C0 to U+00FF; nothing else begins with it.
LATIN = 0xC3


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def checksums(before: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of each stretch of data behind what has the CRC-32 `before`."""
    crc, rows, k = before ^ np.uint32(0xFFFFFFFF), np.flatnonzero(size <= SHORT), 0
    rows = rows[size[rows] > 0]
    while len(rows):
        crc[rows] = CRC[(crc[rows] ^ data[starts[rows] + k]) & 255] ^ (crc[rows] >> 8)
        k += 1
        rows = rows[size[rows] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]], int(before[i]))
    return crc


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: the runs of a slice of texts, some of them with a code point deleted."""
    for b in slices(batches, size=SLICE):
        data, offsets = flat(b.column("text"))
        inside = LETTER[data] | (data == LATIN)
        inside[1:] |= data[:-1] == LATIN
        starts, ends, row = runs(inside, offsets)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = points[ends] - points[starts] >= LEAST_LETTERS
        starts, ends, row = starts[long], ends[long], row[long]
        if not len(starts):
            continue
        d = strings(LOWER[data[covering(starts, ends, len(data))]], ends - starts).dictionary_encode()
        size = len(d.dictionary)
        pairs, n = np.unique(row * size + d.indices.to_numpy(), return_counts=True)
        text, word = pairs // size, pairs % size
        ids = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in b.column("doc_id").to_pylist()], np.uint32)
        bytes_of, at = flat(d.dictionary)
        crc = checksums(ids[text], bytes_of, at[word], at[word + 1] - at[word])
        cut = crc % NOISE == 0
        whole = np.bincount(word[~cut], weights=n[~cut], minlength=size).astype(np.int64)
        less: Counter[str] = Counter()
        for w, h, k in zip(d.dictionary.take(pa.array(word[cut])).to_pylist(), crc[cut].tolist(), n[cut].tolist(), strict=True):
            i = h % len(w)
            if len(w) > LEAST_LETTERS:
                less[w[:i] + w[i + 1 :]] += k
        some = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(some)).cast(pa.string()), pa.array(whole[some])], names=["word", "n"])
        if less:
            yield pa.RecordBatch.from_arrays([pa.array(list(less), pa.string()), pa.array(list(less.values()), pa.int64())], names=["word", "n"])


def lexicon(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs that has enough letters and occurrences."""
    given = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return given.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame, segments: Column, buckets: int) -> DataFrame:
    """rows (word, n, k, own) once for each segment (low, high), with the key of what is outside and its bucket. A word of
    its own class k has k letters; the others have one less, none of it in the gap that an insertion fills."""
    r = rows.withColumn("seg", F.explode(segments)).select("word", "n", "k", "own", "seg.low", "seg.high")
    r = r.withColumn("key", F.xxhash64("k", "low", "high", F.expr("substring(word, 1, low)"), F.expr("substring(word, high + if(own, 1, 0))")))
    return r.withColumn("bucket", F.pmod("key", F.lit(buckets)))


def _halves(low: Column, high: Column) -> Column:
    mid = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), mid.alias("high")), F.struct(mid.alias("low"), high.alias("high")))


def dealt(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """words as own and shorter words of each class, by segment, in buckets of about so many letters."""
    spark = words.sparkSession
    total = words.agg(F.sum(4 * F.length("word"))).first()[0] or 0
    buckets = max(BUCKETS, -(-total // letters))
    n = F.length("word")
    classes = F.array(F.struct(n.alias("k"), F.lit(True).alias("own")), F.struct((n + 1).alias("k"), F.lit(False).alias("own")))
    rows = words.withColumn("c", F.explode(classes)).select("word", "n", "c.*")
    rows, out = _keyed(rows, _halves(F.lit(0), F.col("k")), buckets), None
    while True:
        full = written(rows.groupBy("bucket").agg(F.sum("k").alias("sum")).where(F.col("sum") > letters), work_dir(spark, "full"))
        hot = rows.join(full.select("bucket"), "bucket", "left_semi").where("high - low > 1").groupBy("key").agg(F.sum("k").alias("sum")).where(F.col("sum") > letters).select("key")
        hot = None if full.isEmpty() else written(hot, work_dir(spark, "hot"))
        if hot is None or hot.isEmpty():
            return rows if out is None else out.unionByName(rows)
        rest = rows.join(hot, "key", "left_anti")
        out = rest if out is None else out.unionByName(rest)
        rows = _keyed(rows.join(hot, "key", "left_semi"), _halves(F.col("low"), F.col("high")), buckets)


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, a byte each, and their numbers."""
    data, offsets = flat(words)
    first = data != LATIN
    size = np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])
    return (data + np.where(data >= 0x80, 0x40, 0).astype(np.uint8))[first], size


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of letters, and for each but the first how many letters it shares with the one before."""
    k = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{k}").ravel(), kind="stable")
    s = rows[order]
    return order, np.argmax(s[1:] != s[:-1], axis=1)


def _reach(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The most letters each row shares with another."""
    edge = np.concatenate([[-1], shared, [-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(edge[:-1], edge[1:])
    return out


def _interval(shared: np.ndarray, at: np.ndarray, length: int, own_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own words, by rank, that share so many letters with the rows at these places of the order."""
    edges = np.concatenate([[0], np.flatnonzero(shared < length) + 1, [len(shared) + 1]])
    k = np.searchsorted(edges, at, "right")
    return own_before[edges[k - 1]], own_before[edges[k]]


def near_pairs(rows: np.ndarray, own: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (both ways round) that differ by one letter at a position from low up to high, and each row's rank.
    rows: letters, k to a row, the last of which is 0 where a word is not its class's own. No row occurs twice."""
    k = rows.shape[1]
    back = np.where(own[:, None], rows[:, ::-1], np.roll(rows[:, ::-1], -1, axis=1))
    forward, shared = _ordered(rows)
    reverse, shared_back = _ordered(back)
    place, place_back = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    place[forward] = place_back[reverse] = np.arange(len(rows))
    own_before, own_before_back = (np.concatenate([[0], np.cumsum(own[o])]) for o in (forward, reverse))
    by_back = reverse[own[reverse]]
    tree = Wavelet(own_before_back[place_back[forward[own[forward]]]])
    first, last = np.maximum(low, k - 1 - _reach(reverse, shared_back)), np.minimum(high - 1, _reach(forward, shared))
    asked = np.flatnonzero(first <= last)
    starts, ends = np.bincount(first[asked], minlength=k + 1), np.bincount(last[asked] + 1, minlength=k + 1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(np.cumsum(starts - ends)).tolist():
        q = asked[(first[asked] <= i) & (i <= last[asked])]
        left, right = _interval(shared, place[q], i, own_before)
        bottom, top = _interval(shared_back, place_back[q], k - 1 - i, own_before_back)
        some = (right - left > own[q]) & (top - bottom > own[q])
        q = q[some]
        of, y = tree.report(left[some], right[some], bottom[some], top[some])
        x, y = q[of], by_back[y]
        replaced = own[x] & (x != y)
        inserted = ~own[x] & ((rows[y, i] != rows[x, i - 1]) if i else True)  # a letter beside its like counts once
        a += [x[replaced], x[inserted], y[inserted]]
        b += [y[replaced], y[inserted], x[inserted]]
    return np.concatenate(a), np.concatenate(b), place


def _solved(bucket: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: of each word of a bucket its near words there, by number, and the best of them."""
    out: list[list] = [[], [], [], []]
    key = bucket.column("key").to_numpy()
    _, of, many = np.unique(key, return_inverse=True, return_counts=True)
    bucket = bucket.filter(pa.array(many[of] > 1))  # alone with its key, a word has no near one here
    kinds = np.stack([bucket.column(c).to_numpy() for c in ("k", "low", "high")]) if bucket.num_rows else np.zeros((3, 0), np.int64)
    for k, low, high in np.unique(kinds, axis=1).T.tolist():
        t = bucket.filter(pa.array((kinds == [[k], [low], [high]]).all(axis=0)))
        words, n, own = t.column("word").combine_chunks(), t.column("n").to_numpy(), t.column("own").to_numpy(zero_copy_only=False)
        letters, size = _latin(words)
        rows = np.zeros((len(n), k), np.uint8)
        rows[np.arange(k) < size[:, None]] = letters
        a, b, place = near_pairs(rows, own, low, high)
        if not len(a):
            continue
        order = np.lexsort((place[b], -n[b], a))
        a, b = a[order], b[order]
        _, first, near = np.unique(a, return_index=True, return_counts=True)
        for x, y in zip(out, (words.take(pa.array(a[first])), near, n[b[first]], words.take(pa.array(b[first]))), strict=True):
            x.append(pa.array(y) if isinstance(y, np.ndarray) else y)
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = [pa.concat_arrays([x.cast(t) for x in c]) if c else pa.array([], t) for c, t in zip(out, types, strict=True)]
    return pa.Table.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def near(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word, n_near, best (n, word): of each of the words (word, n) that has near ones their number, and the most frequent."""
    found = dealt(words, letters).groupBy("bucket").applyInArrow(_solved, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def rooted(forms: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """word, root: where the forms (word, form) lead in the end. Each step leads to a word of `times` its count at least, so
    a way has at most log(most) steps; their number doubles with each round."""
    spark, steps, reached = forms.sparkSession, 0, 1
    while most >= LEAST_COUNT * times ** (steps + 1):
        steps += 1
    home = work_dir(spark, "roots")
    at, k = written(forms.select("word", F.col("form").alias("root")), f"{home}/0"), 0
    while reached < steps:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"{home}/{k + 1}")
        remove(spark, f"{home}/{k}")
        k, reached = k + 1, 2 * reached
    return at


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs' texts."""
    spark = docs.sparkSession
    words = written(lexicon(docs), work_dir(spark, "lexicon"))
    t = words.join(near(words, letters), "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    t = t.select("word", F.when(F.col("is_form"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n"))
    t = written(t, work_dir(spark, "forms"))
    roots = rooted(t.where("form is not null"), words.agg(F.max("n")).first()[0] or 0, times)
    return t.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

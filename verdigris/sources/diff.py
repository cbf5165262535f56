"""Unified diffs as hunks, and the old lines that hunks touch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.storage import work_dir, written

#: Bytes of a diff that one task reads at a time, about.
PIECE = 4 << 20


def hunks(diffs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, file, old_start, old_count of each hunk header of each diff text. A hunk belongs to the file named last:
    by `+++ `, or by `--- ` if that was /dev/null. A header before any file, or that is malformed, gives no hunk. Lines
    of a hunk are counted, so a deleted `-- x` or an added `++ x` in it names no file.

    A text of up to `piece` bytes is read where it is. A longer one is cut at line ends, and its pieces are dealt out: what
    a piece does to the lines left of a hunk is known without what came before (it sets them, or takes some away), and so
    is what it does to the files' names; both are carried over the pieces in order, a row a piece, and each piece is read
    with what comes in."""
    id_type = diffs.schema[doc_id].dataType.simpleString()
    given = diffs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = F.octet_length("text")
    out = given.where(size <= piece).mapInArrow(_read_whole, f"doc_id {id_type}, file string, old_start int, old_count int")
    spark = diffs.sparkSession
    cut = given.where(size > piece).withColumn("doc", F.monotonically_increasing_id())
    cut = cut.mapInArrow(lambda b: _cut(b, piece), f"doc_id {id_type}, doc long, k long, text binary")
    home = work_dir(spark, "diffs")
    pieces = written(cut.repartition("doc", "k"), f"{home}/pieces")
    if pieces.isEmpty():
        return out
    # a piece resets what is left of a hunk, or takes from what comes in
    sums = pieces.mapInArrow(_summed, "doc long, k long, resets boolean, old_left long, new_left long")
    w = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("since", F.coalesce(F.count_if("resets").over(Window.partitionBy("doc").orderBy("k")), F.lit(0)))
    so_far = Window.partitionBy("doc", "since").orderBy("k")
    sums = sums.withColumns({c: F.sum(c).over(so_far) for c in ("old_left", "new_left")})
    came = sums.select("doc", "k", *(F.coalesce(F.lag(c).over(Window.partitionBy("doc").orderBy("k")), F.lit(0)).alias(c) for c in ("old_left", "new_left")))
    read = written(pieces.join(came, ["doc", "k"]).mapInArrow(_read_pieces, f"doc_id {id_type}, doc long, k long, ends boolean, {_FOUND}"), f"{home}/read")
    last = lambda known, value: F.last(F.when(F.col(known), F.struct(*(F.col(v) for v in value))), True).over(w)
    before = read.where("ends").select("doc", "k", last("has_old", ["old"]).alias("old_in"), last("has_top", ["is_new", "new"]).alias("top_in"))
    r = read.where("not ends").join(before, ["doc", "k"])
    old = F.when(F.col("has_old"), F.col("old")).otherwise(F.col("old_in.old"))
    is_new, new = (F.when(F.col("has_top"), F.col(c)).otherwise(F.col(f"top_in.{c}")) for c in ("is_new", "new"))
    long = r.select("doc_id", F.when(is_new, F.coalesce(new, old)).alias("file"), "old_start", "old_count").where("file is not null")
    return out.union(long)


_FOUND = "file string, old_start int, old_count int, has_old boolean, old string, has_top boolean, is_new boolean, new string"
_HUNK = re.compile(rb"@@ (?:[^-\s]\S* )*-(\d+)(?:,(\d+))?(?:\s+[+]\d+(?:,(\d+))?)?(?=\s|$)")
_ADDED = re.compile(rb"@@ [^+]*[+]\d+(?=[\s,])")
OLD, NEW, HUNK, OTHER = 1, 2, 3, 4


class _Lines:
    """The lines of texts that lie one behind the other: where those begin that may be headers, their kind and text, and
    how many lines that count for the old and the new file come before each."""

    def __init__(self, raw: bytes, starts: np.ndarray | None = None):
        data = np.frombuffer(raw + b"\0" * 5, np.uint8)
        starts = np.zeros(1, np.int64) if starts is None else starts
        at = np.unique(np.concatenate([starts, np.flatnonzero(data[:-5] == 10) + 1]))
        at = at[at < len(raw)]
        first, end = data[at], np.append(at[1:], len(raw))
        both = (first == 32) | (first == 10)
        self.old, self.new = (np.concatenate([[0], np.cumsum(both | (first == x))]) for x in (45, 43))
        kind = np.zeros(len(at), np.int8)
        for k, mark in ((OLD, b"--- "), (NEW, b"+++ "), (HUNK, b"@@ "), (OTHER, b"diff ")):
            rows = np.flatnonzero((first == mark[0]) & (end - at >= len(mark)))
            for j in range(1, len(mark)):
                rows = rows[data[at[rows] + j] == mark[j]]
            kind[rows] = k
        self.marks = np.flatnonzero(kind)
        self.raw, self.kind, self.at, self.end = raw, kind, at, end
        self.text = np.searchsorted(starts, at[self.marks], "right") - 1

    def line(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.end[i]].removesuffix(b"\n")


def _number(x: bytes | None) -> int | None:
    return int(x) if x and int(x) < 2**31 else None


def _header(line: bytes) -> tuple[int | None, int | None, int]:
    """Start and count of the old lines, null if malformed, and the count of the new ones."""
    m = _HUNK.match(line)
    start = _number(m[1]) if m else None
    count = _number(m[2]) if m else None
    new = (_number(m[3]) if m else None) if _ADDED.match(line) else 0
    return start, None if start is None else 1 if count is None else count, 1 if new is None else new


def bare_path(line: bytes) -> str | None:
    """The path of a `---` or `+++` line: up to a tab, trimmed, without one leading a/ or b/; null for /dev/null."""
    name = line[4:].split(b"\t")[0].strip(b" ").decode("utf-8", "replace")
    return None if name == "/dev/null" else name[2:] if name[:2] in ("a/", "b/") else name


def _walk(x: _Lines, old_left: int = 0, new_left: int = 0) -> Iterator[tuple]:
    """Of each well-formed hunk header its text's number, and what _FOUND names after the file; the same at the end."""
    old_at = new_at = text = 0
    has_old = has_top = is_new = False
    old = new = None
    for i, kind, of in zip(x.marks.tolist(), x.kind[x.marks].tolist(), x.text.tolist(), strict=True):
        if of != text:
            text, old_left, new_left, has_old, has_top, is_new, old, new = of, 0, 0, False, False, False, None, None
            old_at, new_at = int(x.old[i]), int(x.new[i])
        if kind == OLD and old_left <= x.old[i] - old_at:
            has_old, old, has_top, is_new, new = True, bare_path(x.line(i)), True, False, None
        elif kind == NEW and new_left <= x.new[i] - new_at:
            has_top, is_new, new = True, True, bare_path(x.line(i))
        elif kind >= HUNK:
            start, old_left, new_left = _header(x.line(i)) if kind == HUNK else (None, None, 0)
            old_left, old_at, new_at = old_left or 0, int(x.old[i]), int(x.new[i])
            if start is not None:
                yield of, start, old_left, has_old, old, has_top, is_new, new
    yield text, None, None, has_old, old, has_top, is_new, new


def _batch(rows: list[tuple], schema: str, id_type: pa.DataType) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(t, id_type)) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, rows = b.column(0).to_pylist(), [(t or "").encode() for t in b.column(1).to_pylist()], []
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
        for of, start, count, *known in _walk(_Lines(b"".join(texts), starts)) if texts else ():
            file = (known[4] if known[4] is not None else known[1]) if known[3] else None
            if start is not None and file is not None:
                rows.append((ids[of], file, start, count))
        yield _batch(rows, "doc_id id, file string, old_start int, old_count int", b.schema.field(0).type)


def _cut(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, text, doc in zip(*b.columns, strict=True):
            raw, at, k = text.as_py().encode(), 0, 0
            while at < len(raw):
                end = raw.find(b"\n", at + piece - 1) + 1 or len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], b.schema.field(0).type), pa.array([doc.as_py()]), pa.array([k]), pa.array([raw[at:end]], pa.binary())], names=["doc_id", "doc", "k", "text"])
                at, k = end, k + 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, k, raw in zip(*(b.column(c).to_pylist() for c in ("doc", "k", "text")), strict=True):
            x = _Lines(raw)
            resets = x.marks[x.kind[x.marks] >= HUNK]
            i = int(resets[-1]) if len(resets) else 0
            _, old, new = _header(x.line(i)) if len(resets) and x.kind[i] == HUNK else (None, 0, 0)
            rows.append((doc, k, len(resets) > 0, (old or 0) - int(x.old[-1] - x.old[i]), new - int(x.new[-1] - x.new[i])))
        yield _batch(rows, "doc long, k long, resets boolean, old_left long, new_left long", pa.int64())


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, doc, k, raw, old, new in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc", "k", "text", "old_left", "new_left")), strict=True):
            rows += [(doc_id, doc, k, start is None, None, start, count, *known) for _, start, count, *known in _walk(_Lines(raw), old, new)]
        yield _batch(rows, f"doc_id id, doc long, k long, ends boolean, {_FOUND}", b.schema.field("doc_id").type)


def touched_lines(hunks: DataFrame) -> DataFrame:
    """file, line: the old lines of hunks; an insertion touches the lines on both sides of it."""
    first, last = F.col("old_start"), F.when(F.col("old_count") == 0, F.col("old_start") + 1).otherwise(F.col("old_start") + F.col("old_count") - 1)
    return hunks.select("file", F.explode(F.sequence(first, last)).alias("line")).distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The hunks of captured diff files, one document a file."""
    return hunks(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text")))


def changed_files(tracked: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """path: tracked and untracked changes, each once, without blanks. The caller orders where order matters."""
    both = tracked.select("path") if untracked is None else tracked.select("path").union(untracked.select("path"))
    return both.where("trim(path) <> ''").distinct()

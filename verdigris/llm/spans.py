"""Spans of kinds in a text, and the digest columns that queries return for them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm.text import slices

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the given order, then end, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def found(docs: DataFrame, find: Callable[[str], list[Span]], base: tuple[str, ...], kinds: tuple[str, ...], text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_<kind> for each base kind, base_sha256, spans (all kinds; starts and ends in code
    points). A null text is empty and has no spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                own = find(t) if t else []
                first = [s for s in own if s[0] in base]
                rows.append((*(sum(s[0] == k for s in first) for k in base), hashlib.sha256(joined(first, kinds).encode()).hexdigest(), joined(own, kinds)))
            cols = list(zip(*rows, strict=True)) or [()] * (len(base) + 2)
            types = [*[pa.int64()] * len(base), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    names = [*(f"n_{k}" for k in base), "base_sha256", "spans"]
    given = docs.selectExpr("cast(doc_id as bigint) doc_id", f"`{text}` text")
    return given.mapInArrow(scan, "doc_id long, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string")

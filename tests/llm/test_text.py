import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import bitmap, text
from verdigris.llm.components import components


def _words(t):
    return (t or "").encode().lower().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBzZé \t\n\x0b\x0c\r\x1c .", max_size=40)), max_size=8))
def test_hashes_stand_for_words(texts):
    h, first = text.hashed(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [len(_words(t)) for t in texts] == text.n_words(pa.array(texts, pa.string())).tolist()
    seen = {}
    for w, x in zip([w for t in texts for w in _words(t)], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_slices_of_arrays_and_long_texts():
    t = pa.array(["a b", None, "c" * 5000 + " d", "e f g"])
    b = pa.RecordBatch.from_arrays([t], names=["text"])
    parts = list(text.slices(iter([b, b.slice(1)]), size=100))
    assert [p.num_rows for p in parts] == [2, 1, 1, 1, 1, 1] or sum(p.num_rows for p in parts) == 7
    whole, _ = text.hashed(t)
    assert np.concatenate([text.hashed(p.column("text"))[0] for p in parts[: len(parts) - 2]]).size <= 2 * whole.size
    assert (text.hashed(t.slice(2))[0] == whole[2:]).all()
    other = text.word_hashes(*_flat(pa.array(["Ab"])), fold=False)[0]
    assert other != text.word_hashes(*_flat(pa.array(["ab"])), fold=False)[0] and text.hashed(pa.array(["Ab"]))[0][0] == text.hashed(pa.array(["ab"]))[0][0]


def _flat(a):
    data, offsets = text.flat(a)
    starts, ends, _ = text.bounds(data, offsets)
    return data, starts, ends


def test_words_that_collide_under_polynomials(mirrored):
    words = [w[:n] for w in mirrored for n in (8, 16, 64, 65, 512, 1024, 2048)]
    h = text.hashed(pa.array([" ".join(words), *words]))[0]
    assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def test_equal_bytes():
    raw = b"abcdefgh" * 20 + b"abcdefgX" + b"abcdefgh" * 19
    x = text.eights(np.frombuffer(raw, np.uint8))
    pairs = [(a, b, n) for a in (0, 1, 8) for b in (0, 8, 16, 168) for n in (0, 1, 7, 8, 9, 64, 65, 100, 150)]
    a, b, n = (np.array(v) for v in zip(*pairs, strict=True))
    assert text.same_bytes(x, a, x, b, n).tolist() == [raw[p : p + k] == raw[q : q + k] for p, q, k in pairs]


def test_windows_are_local():
    h = text.hashed(pa.array(["a b c d a b c"]))[0]
    w = text.windows(h, 3)
    assert len(w) == 5 and w[0] == w[4] and len(set(w.tolist())) == 4 and len(text.windows(h, 8)) == 0


def test_bitmap_never_misses(spark):
    x = [k * 7919 - 10**6 for k in range(500)]
    m = bitmap.build(spark.createDataFrame([(v,) for v in [*x, x[0], None]], "h long"))
    assert len(m) == 1 << (bitmap.BITS - 3)
    assert bitmap.hits(m, np.array(x, np.int64).view(np.uint64)).all()
    assert bitmap.hits(m, text.mix(np.arange(100_000, dtype=np.uint64))).sum() < 10
    assert not bitmap.build(spark.createDataFrame([], "h long")).any()


def test_components(spark):
    def got(links):
        return {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}

    assert got([(1, 2), (2, 1), (3, 2), (5, 5), (9, 8), (-4, 9)]) == {2: 1, 3: 1, 9: -4, 8: -4}
    assert got([(k, k + 1) for k in range(60)]) == {k: 0 for k in range(1, 61)}
    assert got([(0, k) for k in range(1, 200)]) == {k: 0 for k in range(1, 200)} and got([]) == {}
    assert zlib.crc32(b"") == 0

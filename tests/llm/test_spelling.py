"""Spelling variants against a plain comparison, with groups dealt again, long words, and every letter of the range."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from verdigris.llm import spelling
from verdigris.llm.wavelet import Wavelet

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(rows):
    n, less, near = brute_words(rows), defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less[w[:i] + w[i + 1 :], i].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda u: (-n[u], u)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, letters, stems, rows):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 10))) for _ in range(stems)]
    out = []
    for k in range(rows):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.15)), stems - 1)]
            while r.random() < 0.3:
                i, c = r.randrange(len(w) + 1), r.choice(letters)
                w = r.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((k, r.choice([" ", "1", "\n", ", "]).join(words)))
    return out


def test_wavelet():
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 7, 64, 300):
        y = r.permutation(size)
        a, b, c, d = (r.integers(0, size + 1, 50) for _ in range(4))
        of, got = Wavelet(y).report(a, b, c, d)
        want = sorted((k, int(v)) for k in range(50) for v in y[a[k] : b[k]] if c[k] <= v < d[k])
        assert sorted(zip(of.tolist(), got.tolist(), strict=True)) == want


def test_checksums():
    words = ["", "a", "abc", "\u00e9t\u00e9", "x" * 500]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    got = spelling.checksums(np.array([zlib.crc32(b"7:")] * len(words), np.uint32), data, np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(f"7:{w}".encode()) for w in words]


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "abcd\u00e9\u00ff"), (3, "aeinrst\u00d7\u00c0")])
def test_against_a_plain_comparison(spark, seed, letters):
    given = made(seed, letters, 60, 120)
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert sorted(map(tuple, spelling.variants(df).collect())) == brute(given)


def test_full_buckets_are_dealt_again(spark):
    """With room for few letters, segments are halved down to single positions, and nothing changes."""
    given = made(5, "ab", 40, 100)
    words = spark.createDataFrame(list(brute_words(given).items()), "word string, n long")
    whole = spelling.dealt(words)
    again = spelling.dealt(words, 30)
    width = lambda d: d.selectExpr("min(high - low)").first()[0]
    assert width(whole) >= 3 and width(again) == 1
    assert sorted(map(tuple, spelling.near(words, 30).collect())) == sorted(map(tuple, spelling.near(words).collect()))
    assert sorted(map(tuple, spelling.variants(spark.createDataFrame(given, "doc_id long, text string"), letters=30).collect())) == brute(given)


def test_odd_cases(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.variants(docs).collect())) == brute(rows)
    assert spelling.variants(empty).count() == 0
    long = "abcdefghij" * 3000
    given = [(None, f"{long} {long}"), (1, f"{long}x {long}x x{long} x{long} {long[:15000]}{long[15001:]} {long[:15000]}{long[15001:]}"), (2, "aaaaaaaa " * 40 + "aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa"), (3, None), (4, "caf\u00c9teria CAF\u00e9teria\u4e2dcaf\u00e9teria caf\u00c9teria \u00d7\u00f7\u00d7\u00f7\u00d7\u00f7\u00d7 \u00d7\u00f7\u00d7\u00f7\u00d7\u00f7\u00d7")]
    given += [(8, "chained " * 1000 + "chainex " * 90 + "chxinex " * 8), (5, "short words only"), (5, "short words only")]
    df = spark.createDataFrame([(*x, "s", 1) for x in given], "doc_id long, text string, word string, n int")
    got = sorted(map(tuple, spelling.variants(df).collect()))
    assert got == brute(given)
    assert [r for r in got if r[0] in ("chxinex", "chainex")] == [("chainex", "chained", "chained", 90, 2, 1000), ("chxinex", "chainex", "chained", 8, 1, 90)]

"""Language model, store, near duplicates, decontamination and the pipeline against brute-force versions."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import decontaminate, lm, ngram_join, queries, store
from verdigris.llm.text import U, mix


def _words(t):
    return (t or "").encode().lower().split()


def _held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _discounts(counts):
    n1, n2, n3, n4 = (sum(1 for c in counts if c == i) for i in range(1, 5))
    if not n1 or not n2:
        return [0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]


def brute_lm(rows):
    text = [(d, [*_words(t), b" end"]) for d, t in rows]
    train = [w for d, w in text if not _held(d)]
    uni = Counter(t for w in train for t in w)
    pairs = Counter(p for w in train for p in zip([b" begin", *w], w, strict=False))
    before, context, back = Counter(w for _, w in pairs), Counter(), Counter()
    d2 = _discounts(pairs.values())
    for (v, _), c in pairs.items():
        context[v] += c
        back[v] += d2[min(c, 3)]
    d1, n, v1 = _discounts(before.values()), sum(uni.values()), len(uni) + 1
    left = sum(d1[min(c, 3)] for c in before.values()) / len(pairs) if pairs else 1.0

    def low(w):
        return (max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) if pairs else 0) + left / v1

    def p(v, w):
        c = pairs[v, w]
        return max(c - d2[min(c, 3)], 0) / context[v] + back[v] / context[v] * low(w) if context[v] else low(w)

    return [(d, _held(d), len(w), sum(uni[t] > 0 for t in w), n, sum(math.log10((uni[t] + 1) / (n + v1)) for t in w), sum(math.log10(p(a, b)) for a, b in zip([b" begin", *w], w, strict=False))) for d, w in text]


@pytest.mark.parametrize("which", ["docs", "held", "one"])
def test_language_model(spark, docs, which):
    d = {"docs": docs, "held": docs.where("false or doc_id in (" + ",".join(str(k) for k in range(400) if _held(k)) + ")"), "one": docs.where("doc_id = 0")}[which]
    got = sorted((tuple(r)[:7] for r in lm.trained_and_scored(d).collect()), key=repr)
    want = sorted(brute_lm([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]), key=repr)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_language_model_without_rows(empty):
    assert lm.trained_and_scored(empty).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 2**40))
def test_packed_arrays_come_back(keys, count):
    k = np.unique(np.array(keys, U))
    c = np.full(len(k), count, np.int64)
    a, b = lm.unpacked(lm.packed(k, c))
    assert (a == k).all() and (b == c).all()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(store.default_tokenizer())


ODD = st.text(alphabet="aAéÉßÑ'sStT \t\n　́ .,-#<|>12Σſ÷日中", max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD, st.just("x<|endoftext|>y"), st.just("<|ENDOFTEXT|>")), max_size=6))
def test_encoder_equals_the_library(tokenizer, texts):
    ids, offsets = store.encoder(store.default_tokenizer()).encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_mirrored_words_stay_apart(spark, tokenizer, mirrored, tmp_path):
    """Words that collide under polynomial hashes, through the model, the store and the join."""
    a, b = mirrored
    rows = [(1, f"{a} tail"), (3, f"{b} tail"), (4, f"{a} {a} {b}"), (5, b), (6, f"{a} tail")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.joined(d).collect()) == brute_components(rows, 3, 90)
    for r, w in zip(sorted((tuple(r)[:7] for r in lm.trained_and_scored(d).collect()), key=lambda r: r[0]), brute_lm(rows), strict=True):
        assert r[:5] == w[:5] and r[5:] == pytest.approx(w[5:], rel=1e-9)
    store.write(d, f"file://{tmp_path}/s", store.default_tokenizer())
    assert [r["ids"] for r in store.rebuilt(spark, f"file://{tmp_path}/s").orderBy("start").collect()] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]


def test_encoder_survives_colliding_hashes(tokenizer, monkeypatch):
    monkeypatch.setattr(store, "word_hashes", lambda data, starts, ends, fold=True: (ends - starts).astype(U) % U(5))
    own, texts = store.Encoder(store.default_tokenizer()), ["some words of one length", "and others Four five, six", None, "<|endoftext|> <|ENDOFTEXT|>"]
    for _ in range(2):
        ids, offsets = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_other_tokenizers_encode_text_by_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, offsets = store.encoder(path).encode(pa.array(["Hello, world", None, " x  y"]))
    want = Tokenizer.from_file(path).encode_batch(["Hello, world", "", " x  y"], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*e.ids, 1] for e in want]


@given(st.binary(max_size=60), st.binary(max_size=300))
def test_checksums_combine(a, b):
    assert int(store.shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_chunks_depend_on_the_document_alone():
    r = np.random.default_rng(1)
    one, two = r.integers(0, 40000, 9000).astype(np.uint32), r.integers(0, 40000, 700).astype(np.uint32)
    alone = store.cuts(one, np.array([0, len(one)]))[0]
    after = store.cuts(np.concatenate([two, one, two[:3], two[:0]]), np.array([0, 700, 9700, 9703, 9703]))
    assert (after[1] - 700 == alone).all() and after[2].tolist() == [9703] and alone[-1] == 9000
    size = np.diff([0, *alone])
    assert size.max() <= store.MOST and (size[:-1] >= store.LEAST).all()
    edited = np.concatenate([one[:4000], two[:5], one[4000:]])
    pieces = lambda x: {store.digest(x[a:b].tobytes()) for c in store.cuts(x, np.array([0, len(x)])) for a, b in zip([0, *c[:-1]], c, strict=True)}
    assert len(pieces(one) & pieces(edited)) >= 0.8 * len(alone)


def test_merkle_roots():
    leaves = [bytes([k]) for k in range(9)]
    roots = [store.merkle(leaves[:k]) for k in range(10)]
    assert len(set(roots)) == 10 and store.merkle(leaves) != store.merkle(leaves[::-1])


def test_store(spark, docs, empty, tokenizer, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    root = store.write(docs, path, store.default_tokenizer())
    encoded = sorted(((d is not None, d or 0), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    got = sorted(tuple(r) for r in store.read(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    at = 0
    for (known, d), ids in encoded:
        assert got.pop(0) == (at, d if known else None, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert [r["ids"] for r in store.rebuilt(spark, path).orderBy("start").collect()] == [x for _, x in encoded]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.select("digest").distinct().count() == chunks.count() < sum(len(r["digests"]) for r in spark.read.parquet(f"{path}/recipes").collect())
    assert sum(r["docs"] for r in spark.read.parquet(f"{path}/manifest").collect()) == len(rows)
    assert store.write(docs.repartition(5), f"file://{tmp_path}/again", store.default_tokenizer()) != "" and len(root) == 32
    bad = chunks.selectExpr("digest", "n", "case when n > 20 then concat(ids, X'00') else ids end ids").collect()
    spark.createDataFrame(bad, chunks.schema).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="digest"):
        store.read(spark, path).collect()
    assert store.stored(empty, store.default_tokenizer()).count() == 0


def test_store_misses_what_is_gone(spark, docs, tmp_path):
    import shutil

    good = tmp_path / "good"
    root = store.write(docs, f"file://{good}", store.default_tokenizer())
    assert store.read(spark, f"file://{good}", root).count() == store.rebuilt(spark, f"file://{good}", root).count() == docs.count()
    for k, reader in enumerate((store.read, store.rebuilt)):
        with pytest.raises(Exception, match="root over all parts"):
            reader(spark, f"file://{good}", "00" * 16).collect()
        for table, says in (("recipes", "manifest"), ("manifest", "root over all parts"), ("chunks", "chunk that is missing")):
            path = tmp_path / f"{table}{k}"
            shutil.copytree(good, path)
            max((path / table).glob("*.parquet"), key=lambda p: p.stat().st_size).unlink()
            for crc in (path / table).glob(".*.crc"):
                crc.unlink()
            with pytest.raises(Exception, match=says):
                reader(spark, f"file://{path}").collect()
        path = f"file://{tmp_path}/short{k}"
        shutil.copytree(good, path[7:])
        chunks = spark.read.parquet(f"file://{good}/chunks")
        chunks.where(chunks.n < chunks.agg({"n": "max"}).first()[0]).write.mode("overwrite").parquet(f"{path}/chunks")
        with pytest.raises(Exception, match="chunk that is missing"):
            reader(spark, path).collect()
        bad = chunks.selectExpr("digest", "n", "case when n > 20 then concat(substr(ids, 3), X'0000') else ids end ids")
        bad.write.mode("overwrite").parquet(f"{path}/chunks")
        with pytest.raises(Exception, match="does not match its digest"):
            reader(spark, path).collect()


def test_store_sees_changed_recipes(spark, docs, tmp_path):
    good = f"file://{tmp_path}/good"
    store.write(docs, good, store.default_tokenizer())
    recipes = spark.read.parquet(f"{good}/recipes")
    first, second, third = [r[0] for r in recipes.where("doc_id is not null").orderBy("start").select("doc_id").limit(3).collect()]
    swapped = f"case doc_id when {first} then {third} when {third} then {first} else doc_id end doc_id"
    changes = {
        "gone": recipes.where(f"doc_id is null or doc_id <> {second}"), "swapped": recipes.selectExpr("part", swapped, *recipes.columns[2:]),
        "moved": recipes.selectExpr("part", "doc_id", "start + 1 start", *recipes.columns[3:]), "lengths": recipes.selectExpr(*recipes.columns[:5], "reverse(lens) lens", "root"),
    }
    for name, table in changes.items():
        path = f"file://{tmp_path}/{name}"
        for x in ("chunks", "manifest", "root"):
            spark.read.parquet(f"{good}/{x}").write.parquet(f"{path}/{x}")
        table.write.parquet(f"{path}/recipes")
        for reader in (store.read, store.rebuilt):
            with pytest.raises(Exception, match="does not|do not"):
                reader(spark, path).collect()


def shingles(t, k):
    w = _words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] * bool(w))


def brute_components(rows, k, num, den=100):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i), d) if s else d) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 60), (1, 50)])
def test_near_duplicates(docs, k, num):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in ngram_join.joined(docs, k=k, num=num).collect()), key=repr) == brute_components(rows, k, num)


def _bent(n=120, seed=5):
    """Near copies of one text, many of them farther from each other than the limit."""
    r = np.random.default_rng(seed)
    base, rows = [f"w{k}" for k in range(60)], []
    for d in range(n):
        w = list(base)
        for at in r.integers(0, 60, r.integers(0, 9)):
            w[at] = f"x{r.integers(0, 30)}"
        rows.append((d, " ".join(w)))
    return rows


def test_near_duplicates_in_hot_groups(spark, monkeypatch):
    """In several blocks, and with hot signatures dealt to parts."""
    for name, value in (("SKETCH_BLOCK", 700), ("SET_BLOCK", 4000), ("BLOCKS", 5), ("BLOCK_BYTES", 2000)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = _bent(300)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sig = ngram_join._near(d.select("text").coalesce(1), ngram_join.Plan(90, 100, 300), 3, 64)
    assert sig.groupBy("pivot").count().agg({"count": "max"}).first()[0] >= ngram_join.HOT
    got = sorted((tuple(x) for x in ngram_join.joined(d.coalesce(1)).collect()), key=repr)
    want = brute_components(rows, 3, 90)
    assert got == want and 10 < len({c for _, _, c in want}) < 290


def test_hot_signatures_are_dealt_apart():
    r = np.random.default_rng(1)
    sig, cls = np.concatenate([np.full(500, 7), np.full(ngram_join.HOT - 1, 8), r.integers(100, 10**6, 300)]), r.integers(-(2**62), 2**62, 800 + ngram_join.HOT - 1)
    b = ngram_join._hot_apart(sig, cls).to_pandas()
    assert sorted(zip(b.sig[b.part >= 0], b.cls[b.part >= 0], strict=True)) == sorted(zip(sig, cls, strict=True))
    assert set(b.sig[b.part > 0]) == {7} == set(b.sig[b.part < 0]) and sorted(b.cls[b.part < 0]) == sorted([cls[:500].min(), cls[:500].max()])
    assert b[b.part > 0].groupby("part").size().max() < 30 and ngram_join._hot_apart(sig[:0], cls[:0]).num_rows == 0


@pytest.mark.parametrize("bits", [1, 4])
def test_clashing_classes(spark, docs, bits):
    """With a first hash of a few bits nearly all classes clash; the result is the same."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(1000 + d, t) for d, t in _bent(40)]
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), class_bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(rows, 3, 90)


def test_near_duplicates_without_rows(empty):
    assert ngram_join.joined(empty).count() == 0


@pytest.mark.parametrize(("num", "n_sets"), [(90, 10**3), (80, 10**3), (60, 10**6), (50, 10**9), (90, 10**9)])
def test_signatures_lose_no_link(num, n_sets):
    r, plan, hits = np.random.default_rng(num), ngram_join.Plan(num, 100, n_sets), 0
    for t in range(700):
        a = np.unique(mix(r.integers(0, 2**63, int(r.integers(1, 150 if t % 3 else 14))).astype(U)))
        d = int(r.integers(0, 2 * len(a) * (100 - num) // (100 + num) + 2))
        out = min(int(r.integers(0, d + 1)), len(a) - 1)
        b = np.unique(np.concatenate([np.delete(a, r.choice(len(a), out, replace=False)), mix(r.integers(0, 2**63, d - out).astype(U))]))
        if ngram_join.linked(a, b, num, 100):
            hits += 1
            assert len(np.intersect1d(plan.signatures(a), plan.signatures(b)))
            bits = 512
            assert np.bitwise_count(ngram_join.sketch(a, bits) ^ ngram_join.sketch(b, bits)).sum() <= len(np.setxor1d(a, b))
    assert hits > 300


def test_both_kinds_of_segments_are_used():
    plan = ngram_join.Plan(90, 100, 10**9)
    kinds = {(e > 0, d > 0) for e, d, _ in (plan.allocate(plan.band(n)) for n in (5, 12, 40, 500, 5000))}
    assert {(True, False), (False, True)} <= kinds


def brute_overlaps(docs, items):
    """Every alignment and stretch: n_words of the longest, from LEAST words on; short items as a whole."""
    out = {}
    for d, t in docs:
        w = _words(t)
        for i, u in items:
            v, best = _words(u), None
            if len(v) < decontaminate.SHORTEST:
                continue
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, shift), min(len(w), shift + len(v))
                same = [w[x] == v[x - shift] for x in range(lo, hi)]
                if len(v) < 12:
                    if len(same) == len(v) and all(same):
                        best = len(v)
                    continue
                for a in range(len(same)):
                    for b in range(len(same), a, -1):
                        if 5 * sum(same[a:b]) >= 4 * (b - a) and b - a >= 12 and (best is None or b - a > best):
                            best = b - a
            if best:
                out[d, i] = best
    return out


def test_masks_lose_no_overlap():
    """The least number of substituted words that leaves no seed of n words exceeds a fifth of n, for n from LEAST to 400.
    By states: which of the last SPAN - 1 words are substituted."""
    masks = [(m[-1], sum(1 << (m[-1] - o) for o in m)) for m in decontaminate.MASKS]
    assert all(m[0] == 0 and m[-1] < decontaminate.SPAN for m in decontaminate.MASKS)
    least = {0: 0}
    for n in range(1, 401):
        now = {}
        for state, changed in least.items():
            for bit in (0, 1):
                full = state << 1 | bit
                if all(n <= last or full & places for last, places in masks):
                    k = full & (1 << (decontaminate.SPAN - 1)) - 1
                    now[k] = min(now.get(k, n), changed + bit)
        least = now
        assert n < decontaminate.LEAST or min(least.values()) > n // 5, n


def _bench(spark, rows, bench):
    return decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))


def test_decontamination(spark, empty):
    r = np.random.default_rng(3)
    fill = lambda n: [f"f{x}" for x in r.integers(0, 10**6, n)]
    items = [(k, [f"i{k}x{j}" for j in range(n)]) for k, n in enumerate((30, 14, 12, 9, 6, 2))]
    bent = list(items[0][1])
    for k in (4, 11, 19):
        bent[k] = "other"
    rows = [
        (0, fill(40)), (1, [*fill(30), *items[0][1], *fill(20)]), (2, [*fill(7), *bent, *fill(3)]), (3, items[1][1][1:]), (4, [*fill(3), *items[2][1]]), (5, [*fill(2), *items[3][1], "z"]),
        (6, [*fill(90), *items[4][1]]), (7, items[5][1]), (8, items[0][1][:11]), (9, [*items[0][1], *fill(400), *items[1][1]]), (None, items[1][1]), (11, items[4][1][:4]), (12, [w.upper() for w in items[2][1]]), (15, [*items[3][1][:8], "z"]),
    ]
    rows = [(d, " ".join(w)) for d, w in rows] + [(13, None), (14, ""), (1, " ".join(rows[1][1]))]
    bench = [(k, " ".join(w)) for k, w in items] + [(20, None), (21, " "), (22, " ".join(items[2][1]))]
    got = _bench(spark, rows, bench)
    found = {(x["doc_id"], x["item_id"]): x["n_words"] for x in got.collect()}
    assert found == brute_overlaps(rows, bench) and got.count() == len(found) and (7, 5) not in found and (6, 4) in found
    assert got.where("doc_id = 1 and item_id = 0").first()["doc_word"] == 30
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(empty, none).count() == 0 and _bench(spark, rows, []).count() == 0


def test_decontamination_of_bent_passages(spark):
    """Random substitutions at any rate, in short and long items, far from any seed too: equal to every alignment."""
    r = np.random.default_rng(8)
    items = [(k, [f"i{k}x{j}" for j in range(n)]) for k, n in enumerate((12, 13, 15, 20, 34, 90))]
    rows = []
    for d in range(60):
        w = list(items[d % 6][1])
        a = int(r.integers(0, len(w) - 11))
        w = w[a : a + int(r.integers(12, len(w) - a + 1))]
        for at in r.choice(len(w), int(len(w) * r.choice([0.1, 0.2, 0.2, 0.25])), replace=False):
            w[at] = "other"
        rows.append((d, " ".join([*(f"f{x}" for x in r.integers(0, 10**6, 20)), *w, *(f"g{x}" for x in r.integers(0, 10**6, 20))])))
    rows.append((90, " ".join([*items[5][1][:50], *(["gap"] * 40)])))  # reaches further than any seed
    bench = [(k, " ".join(w)) for k, w in items]
    found = {(x["doc_id"], x["item_id"]): x["n_words"] for x in _bench(spark, rows, bench).collect()}
    want = brute_overlaps(rows, bench)
    assert found == want and 20 < len(want) < 61


def test_decontamination_keeps_other_texts_of_an_id(spark, tmp_path):
    leak = " ".join(f"leak{k}" for k in range(20))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, leak, "a"), (1, "another text", "b"), (None, leak, "c"), (None, None, "d"), (3, leak, "e")]
    got = decontaminate.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, h string"), str(tmp_path))
    assert sorted(r["h"] for r in got.collect()) == ["b", "d"] and got.columns == ["doc_id", "text", "h"]


def test_pipeline(spark, tmp_path, docs, tokenizer):
    import corpus_pipeline

    bench = [(1, " ".join(f"leak{k}" for k in range(30)))]
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
    r = np.random.default_rng(2)
    more = [(500 + k, " ".join(f"v{x}" for x in r.integers(0, 10**6, 80)) + (" " + bench[0][1] if k == 3 else ""), "en", f"s{k % 3}", 1) for k in range(30)]
    d = spark.createDataFrame([*map(tuple, own), *more], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == d.columns, name
        a, b = ({tuple(r) for r in x.collect()} for x in (before, kept))
        assert b <= a
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            roots = {c for _, _, c in brute_components(rows, 5, 80)}
            assert {r["doc_id"] for r in kept.collect()} == roots and kept.count() == len(roots)
        if name == "benchmark decontamination":
            assert {r[0] for r in a - b} == {503}
    out = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    want = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    at = 0
    for (doc_id, start, n, crc), (d2, t) in zip(out, want, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert (doc_id, start, n, crc) == (d2, at, len(ids), zlib.crc32(struct.pack(f"<{n}I", *ids)))
        at += n


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(found)

"""Quality rules, sharding, mixing and chats on small tables with every odd case."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import mixing, quality, shards, toolcalls


def _words(t):
    return [w.decode() for w in (t or "").encode().split()]


def brute_rules(t):
    w, t = _words(t), t or ""
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules(docs, texts, empty, spark):
    more = spark.createDataFrame([(900 + k, t, "s9") for k, t in enumerate(["a b c a b c", "a a a a", "a b c d a b c", "x # ## <|>\n\nx # ## <|>\n \x0b\nx", " a\r\na\r\n"])], "doc_id long, text string, source string")
    for d, carry in ((docs, ["doc_id", "text"]), (more, ["doc_id", "text"])):
        got = quality.judged(d, carry=carry).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert len(got) == d.count()
        for r in got:
            assert tuple(r)[1:] == brute_rules(r["text"]), r["text"]
    assert quality.judged(empty).count() == 0


def test_hosts(spark):
    """The same text is kept or not by its host: slight failures stay where failures are seldom, near ones go where they
    are frequent; gross ones go and clean ones stay everywhere."""
    marked = lambda n: " ".join(f"w{k}" + "#" * (k < n) for k in range(60))
    good, near, mild, gross = marked(0), marked(17), marked(24), " ".join(f"w{k} ###" for k in range(60))
    dull = "\n".join([" ".join(f"v{j}" for j in range(60))] + [" ".join(f"u{j}" for j in range(3))] * 5)
    rows = [(k, gross if k % 4 == 0 else good, "bad") for k in range(200)] + [(200 + k, good, "fine") for k in range(400)]
    odd = {"good": good, "near": near, "mild": mild, "gross": gross, "dull": dull, "short": "short", "null": None}
    hosts = ["bad", "fine", None, "new"]
    rows += [(1000 + 10 * h + k, t, host) for h, host in enumerate(hosts) for k, t in enumerate(odd.values())]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    j = quality.judged(d)
    v = {r["host"]: r for r in quality.host_verdicts(j).collect()}
    assert v["bad"]["symbols_limit"] == 0.8 and v["fine"]["symbols_limit"] == 2.0 and all(v[h]["length_limit"] == 1.0 for h in v), "nobody fails the length rule"
    assert 0 < v["fine"]["symbols_rate"] < v["fine"]["symbols_mean"] < v["new"]["symbols_rate"] < 2 / 7
    kept = {r["doc_id"] for r in j.where("kept").select("row.doc_id").collect()}
    stay = {host: {name for k, name in enumerate(odd) if 1000 + 10 * h + k in kept} for h, host in enumerate(hosts)}
    assert stay["bad"] - {"dull"} == {"good"} and stay["fine"] >= {"good", "near", "mild"} and all("gross" not in x and "short" not in x and "null" not in x and "good" in x for x in stay.values())
    assert kept >= set(range(200, 600)) | {k for k in range(200) if k % 4} and not kept & set(range(0, 200, 4))
    got = quality.stage(spark, d, "")
    assert got.columns == ["doc_id", "text", "source"] and {r["doc_id"] for r in got.collect()} == kept


def test_labelled_documents(spark):
    """On the tables the hosts' verdicts reject documents that pass the base rules, none of them with a label of good
    quality, and differ from the plain rules as well as from none."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    soft = F.col("symbols_failed") | F.col("lines_failed") | F.col("length_failed")
    j = quality.judged(docs, carry=["doc_id"]).select("row.doc_id", "base_failed", "kept", soft.alias("soft_failed"), quality.severities()["symbols"].alias("severity"))
    kept = {r["doc_id"] for r in quality.stage(spark, docs, path).select("doc_id").collect()}
    rows = j.join(labels, "doc_id", "left").collect()
    assert kept == {r["doc_id"] for r in rows if r["kept"]}
    assert sum(r["kept"] == r["base_failed"] for r in rows) >= 500, "unlike no verdict"
    by_host = [r for r in rows if r["kept"] != (not r["base_failed"] and not r["soft_failed"])]
    assert len(by_host) >= 5, "unlike the plain rules"
    gone = [r["severity"] for r in rows if not r["kept"] and not r["base_failed"]]
    assert any(min(gone) < r["severity"] for r in by_host if r["kept"]), "kept though a document nearer to the rule goes elsewhere"
    clean = {r["doc_id"] for r in rows if r["quality"] == 1 and not r["base_failed"]}
    assert clean and clean <= kept


def test_no_python_runs_in_the_rules(docs):
    plan = quality.measures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sharding(docs, empty, spark):
    import zlib

    skewed = spark.createDataFrame([(k, "copy " * 50 if k % 3 == 0 else f"text {k} " * (k % 40)) for k in range(3000)], "doc_id long, text string")
    for d, n in ((docs, 8), (skewed, 8), (skewed, 3)):
        for per in (10**6, 200):
            got = shards.histogram_sort(d, n, rows_per_range=per).collect()
            by, size = defaultdict(list), Counter()
            for r in got:
                by[r["shard"]].append(r["slot"])
                size[r["shard"]] += r["size"]
            assert all(sorted(v) == list(range(len(v))) for v in by.values())
            want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
            assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
            each, most = sum(size.values()) / n, max(r["size"] for r in got)
            assert all(abs(size[k] - each) <= 0.002 * each + 2 * most for k in range(n))
    assert shards.histogram_sort(empty).count() == 0
    same = spark.createDataFrame([(5, "x")] * 40 + [(None, None)] * 2, "doc_id long, text string")
    assert {r["shard"] for r in shards.histogram_sort(same).where("text_crc32 <> 0").collect()} == {r["shard"] for r in shards.histogram_sort(same).where("text_crc32 <> 0").collect()}


def test_shards_are_stretches_of_the_order(docs, spark, monkeypatch):
    """Against a plain sort by (hash, doc_id): shards follow each other, slots count from 0, and each splitter is, to the
    tolerance, the best place in the sorted list for its share of the bytes."""
    skewed = spark.createDataFrame([(k, "copy " * 50 if k % 3 == 0 else f"text {k} " * (k % 40)) for k in range(3000)], "doc_id long, text string")
    for d, n, per, ranges in ((docs, 8, 10**6, 2048), (skewed, 8, 100, 2048), (skewed, 3, 50, 9), (skewed.where("doc_id % 3 = 0"), 5, 10**6, 2048)):
        monkeypatch.setattr(shards, "RANGES", ranges)
        got = {}
        for r in shards.histogram_sort(d, n, rows_per_range=per).collect():
            got.setdefault((r["doc_id"], r["text_crc32"], r["size"]), []).append((r["shard"], r["slot"]))
        order = sorted((r["h"], r["d"], r["size"], r["text_crc32"], r["doc_id"]) for r in shards.keyed(d).collect())
        want, total, at = defaultdict(list), sum(r[2] for r in order), 0
        cuts = [0]
        for r in order:
            cuts.append(cuts[-1] + r[2])
        for v in got.values():
            v.sort()  # repeated rows stand in any order
        flat = [got[r[4], r[3], r[2]].pop(0) for r in order]
        shard = [s for s, _ in flat]
        assert shard == sorted(shard)
        for s, k in flat:
            want[s].append(k)
        assert all(sorted(v) == list(range(len(v))) for v in want.values())
        for k in range(1, n):
            at = cuts[sum(s < k for s in shard)]
            best = min(abs(c - total * k / n) for c in cuts)
            tied = max(Counter((r[0], r[1]) for r in order).values()) * max(r[2] for r in order) if d is docs else 0
            assert abs(at - total * k / n) <= max(best, 0.001 * total / n) + tied


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 10, 1000, 5], [0, 5, 7], [0, 0], [], [1, 10**6, 3, 4, 50, 60]])
def test_targets(sizes):
    t = mixing.targets(sizes)
    assert sum(t) == pytest.approx(sum(sizes))
    assert all(x <= 3 * n + 1e-6 for x, n in zip(t, sizes, strict=True))
    share = [x / (5, 2, 1)[i % 3] for i, (x, n) in enumerate(zip(t, sizes, strict=True)) if x < 3 * n - 1e-6]
    assert not share or max(share) == pytest.approx(min(share))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(p.tolist()) == list(range(n)) and (n < 255 or (p != np.arange(n)).mean() > 0.9)


def brute_taken(rows, goals, block):
    """Words taken of each document: each source's words in order, cut to blocks, gone through as permuted."""
    out = []
    for source, goal in goals.items():
        own = sorted((r for r in rows if r[1] == source), key=lambda r: r[2])
        words = [k for k, r in enumerate(own) for _ in range(r[3])]
        parts = [words[a : a + block] for a in range(0, len(words), block)]
        full, got, epoch = len(words) // block, [], 0
        while len(got) < goal and parts:
            order = mixing.permuted(np.arange(full), full, mixing.SEED + list(goals).index(source) * 1_000_003 + epoch).tolist() + list(range(full, len(parts)))
            for p in order:
                got += parts[p][: goal - len(got)]
            epoch += 1
        taken = Counter(got)
        out += [(r[0], source, r[3], taken[k]) for k, r in enumerate(own)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 256, 10**6])
def test_mixing(docs, empty, block, monkeypatch):
    columns = ("doc_id", "name", "unnamed", "size", "source_size", "target", "taken")
    runs = [sorted((tuple(r) for r in mixing.mixed(docs, block=block).select(*columns).collect()), key=repr)]
    monkeypatch.setattr(mixing, "SOURCES_PER_BUCKET", 2)
    monkeypatch.setattr(mixing, "SLOTS_PER_TASK", 7)
    runs.append(sorted((tuple(r) for r in mixing.mixed(docs.repartition(5), block=block).select(*columns).collect()), key=repr))
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    words = Counter(len(_words(r["text"])) for r in docs.collect())
    assert Counter(r[3] for r in runs[0]) == words
    by = defaultdict(lambda: [0, 0, 0.0])
    for _, name, unnamed, size, total, target, taken in runs[0]:
        source = None if unnamed else name
        assert taken <= 3 * size and total >= size
        by[source][0] += size
        by[source][1] += taken
        by[source][2] = target
    names = sorted(by, key=lambda s: (s is None, s or ""))
    assert mixing.targets([by[s][0] for s in names]) == pytest.approx([by[s][2] for s in names])
    assert all(abs(taken - target) <= 1 for _, taken, target in by.values())
    groups = mixing.LEAST_GROUPS
    order = docs.select("doc_id", "source", F.pmod(F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(groups)).alias("g"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    rows = [(r["doc_id"], r["source"], (r["g"], r["doc_id"] is not None, r["doc_id"] or 0, len(_words(r["text"])), r["h"]), len(_words(r["text"]))) for r in order.collect()]
    goals = {s: min(int(by[s][2] + 0.5), 3 * by[s][0]) for s in names}
    got = sorted(((r[0], None if r[2] else r[1], r[3], r[6]) for r in runs[0]), key=repr)
    assert got == brute_taken(rows, goals, block)
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(docs.withColumn("text", F.lit(None).cast("string"))).where("taken <> 0").count() == 0


def test_mixing_stage(spark, docs):
    m = Counter()
    for r in mixing.mixed(docs).collect():
        m[r["doc_id"], r["h"]] += int(r["taken"] / max(r["size"], 1) + 0.5)
    got = mixing.stage(spark, docs, "")
    assert got.columns == docs.columns
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    assert Counter((r[0], r[1]) for r in got.select("doc_id", key).collect()) == +m and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))


def test_many_sources(spark):
    """Targets of a table of sources equal those of a list, where many rounds are needed too."""
    r = np.random.default_rng(3)
    for sizes in ([int(4.0**k) for k in range(20)], r.integers(0, 1000, 3000).tolist(), [0, 0], [7], []):
        t = mixing.shared(spark.createDataFrame(list(enumerate(sizes)), "i long, size long")).orderBy("i").collect()
        assert [x["target"] for x in t] == pytest.approx(mixing.targets(sizes), rel=1e-9)


def test_slots_follow_shards(spark, monkeypatch):
    for per_bucket in (4096, 1):
        monkeypatch.setattr(mixing, "SOURCES_PER_BUCKET", per_bucket)
        s = mixing.slots(spark.createDataFrame([(0, 1000, 1700), (1, 300, 600), (2, 0, 0)], "i long, size long, goal long"), block=32, shards=5).collect()
        taken = Counter()
        for r in s:
            taken[r["i"]] += r["words"]
        assert taken == {0: 1700, 1: 600}
        per = Counter(r["shard"] for r in s)
        assert set(per) == set(range(5)) and max(per.values()) - min(per.values()) <= 5
        assert all(sorted(r["slot"] for r in s if r["i"] == k) == list(range(sum(r["i"] == k for r in s))) for k in (0, 1))


SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}, "additionalProperties": False}}
CALL = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "add", '{"x": 1.0, "tags": ["é"]}', []), (1, 2, "b", "add", '{"tags":[], "x":-1}', ["a"]), (1, 2, "c", "add", "not json", ["d", "zz"]), (1, 4, "d", "add", '{"x":2,"y":3}', ["b"]),
        (1, 9, "a", "add", "{}", []), (2, 0, "p", "sub", "{}", ["q"]), (2, 0, "q", "add", None, ["p"]), (3, 5, None, "add", '{"x":NaN}', None), (None, 1, "n", "add", "[1]", []), (2, 3, "self", "add", '{"x":true}', ["self"]),
    ]
    results = [(1, 1, "a", "two"), (1, 3, "a", "one"), (1, 1, "b", "early"), (1, 9, "zz", None), (2, 1, "p", ""), (2, 2, None, "lost")]
    got = toolcalls.linked(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMAS)
    r = {(x["conv_id"], x["call_id"], x["status"] == "repeated"): x for x in got.collect()}
    assert got.count() == 12
    at = lambda *k: r[(*k, False)]
    assert [at(1, c)["status"] for c in "abcd"] == ["linked", "early", "unanswered", "unanswered"] and at(1, "zz")["status"] == "orphan"
    again = r[1, "a", True]
    assert (again["turn"], again["name"], again["fault"], again["json"]) == (9, "add", "$.x: required", '{"arguments":{},"id":"a","name":"add","result":null}') and again["order_turn"] is None
    assert at(2, None)["status"] == "orphan" and at(3, None)["status"] == "unanswered" and at(None, "n")["status"] == "unanswered"
    assert (at(1, "a")["result_turn"], at(1, "a")["n_results"], at(1, "a")["fault"]) == (1, 2, None)
    assert [at(1, c)["fault"] for c in "bcd"] == ["$.x: range", "$: not JSON", "$.y: unknown"] and at(2, "p")["fault"] == "$: no schema"
    assert at(2, "q")["fault"] == "$: not JSON" and at(3, None)["fault"] == "$: not JSON" and at(2, "self")["fault"] == "$.x: type"
    assert at(1, "a")["json"] == '{"arguments":{"tags":["é"],"x":1},"id":"a","name":"add","result":{"content":"two","turn":1}}'
    assert json.loads(at(1, "c")["json"])["arguments"] == "not json"
    rank = {k: (at(1, k)["order_turn"], at(1, k)["order_step"]) for k in "abcd"}
    assert rank["a"] < rank["b"] < rank["d"] < rank["c"] == (4, 1)
    assert at(2, "p")["cyclic"] and at(2, "q")["cyclic"] and not at(2, "self")["cyclic"] and not at(1, "c")["cyclic"]
    none = toolcalls.linked(spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT), SCHEMAS)
    assert none.count() == 0


def test_long_chains_are_ordered_beside_cycles(spark):
    chain = lambda conv, n, turn: [(conv, turn(k), f"c{k}", "add", "{}", [f"c{k - 1}"] if k else []) for k in range(n)]
    calls = [*chain(1, 150, lambda k: 3), *chain(2, 90, lambda k: 200 - k), *chain(3, 40, lambda k: None)]
    calls += [(4, 0, "p", "add", "{}", ["q"]), (4, 2, "q", "add", "{}", ["p"]), (4, 1, "behind", "add", "{}", ["p"]), (4, 7, "later", "add", "{}", ["behind"]), (4, 1, "free", "add", "{}", ["x"]), (4, 0, "x", "add", "{}", [])]
    calls += chain(5, 50, lambda k: 2 * k)
    got = toolcalls.linked(spark.createDataFrame(calls, CALL).repartition(7), spark.createDataFrame([], RESULT), SCHEMAS)
    r = {(x["conv_id"], x["call_id"]): (x["order_turn"], x["order_step"], x["cyclic"]) for x in got.collect()}
    assert all(r[1, f"c{k}"] == (3, k, False) for k in range(150)) and all(r[2, f"c{k}"] == (200, k, False) for k in range(90))
    assert all(r[3, f"c{k}"] == (None, k, False) for k in range(40)) and all(r[5, f"c{k}"] == (2 * k, 0, False) for k in range(50))
    assert [r[4, c] for c in ("p", "q", "behind", "later", "free", "x")] == [(0, 0, True), (2, 0, True), (1, 0, True), (7, 0, False), (1, 0, False), (0, 0, False)]


def brute_tangles(spans):
    out = []
    for conv in {c for c, _, _ in spans}:
        open_, first = None, None
        for at, reach in sorted((a, r) for c, a, r in spans if c == conv):
            if open_ is None or open_ < at:
                first = at
            if reach is not None:
                open_ = reach if open_ is None else max(open_, reach)
            if open_ is not None and open_ >= at:
                out.append((conv, at, first))
    return sorted(out)


def test_tangles_of_long_conversations(spark, monkeypatch):
    r = np.random.default_rng(4)
    spans = [(c, int(a), int(a + r.integers(0, reach)) if r.random() < share else None) for c, n, reach, share in ((1, 300, 4, 0.2), (2, 300, 60, 0.05), (3, 50, 400, 0.1), (4, 5, 1, 1.0)) for a in sorted(set(r.integers(-50, 900, n).tolist()))]
    spans += [(5, toolcalls._FIRST, toolcalls._FIRST), (5, 0, None), (5, 3, 7), (5, 7, None), (5, 8, None)]
    for turns in (4096, 16, 1):
        monkeypatch.setattr(toolcalls, "TURNS", turns)
        assert sorted(tuple(x) for x in toolcalls.tangles(spark.createDataFrame(spans, "conv_id long, at long, reach long")).collect()) == brute_tangles(spans)


def test_calls_that_no_parser_likes(spark):
    deep = "[" * 100_000 + "]" * 100_000
    schemas = {"any": {}, "whole": {"properties": {"a": {"type": "integer", "minimum": 0}}}}
    odd = [
        ('{"a":1e999}', "$: number"), ('{"a":-1e999}', "$: number"), ('{"a":"\\ud800"}', None), (deep, "$: depth"), ('{"a":' + deep + "}", "$: depth"), ('{"a":' + "7" * 400 + "}", None), ('{"a":' + "7" * 5000 + "}", "$: number"), ('{"\\udfff":1}', None),
        ("{", "$: not JSON"), ("", "$: not JSON"), ("[[]]", "$: type"), ('{"a":"' + "[" * 5000 + '"}', None), ('{"a":1,"a":-0.0}', None), ('{"a":Infinity}', "$: not JSON"), ("é" * 100_000, "$: not JSON"), ('{"a":"' + "x" * 3_000_000 + '"}', None),
    ]
    calls = [(1, k, f"c{k}", "any", a, None) for k, (a, _) in enumerate(odd)] + [(2, 0, "int", "whole", odd[5][0], None), (2, 1, "sur", "whole", '{"a":"\\ud800"}', [None, "int"])]
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.linked(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), schemas).collect()}
    assert [got[1, f"c{k}"]["fault"] for k in range(len(odd))] == [f for _, f in odd]
    assert got[2, "int"]["fault"] is None and got[2, "sur"]["fault"] == "$.a: type" and json.loads(got[1, "c2"]["json"])["arguments"] == {"a": "\ud800"}
    assert json.loads(got[1, "c5"]["json"])["arguments"]["a"] == int("7" * 400) and '{"a":0}' in got[1, "c12"]["json"]
    for bad in ({"x": {"type": "float"}}, {"x": {"items": {"type": ["null", "int"]}}}, {"x": {"properties": {"y": {"type": "any"}}}}):
        with pytest.raises(ValueError, match="unknown type"):
            toolcalls.linked(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), bad)


def test_chats_as_calls_hold_every_case(spark):
    """The query's own rows order calls inside turns and across them, hold cycles and break schemas."""
    from verdigris.llm.queries import op1_tool_calls

    r = op1_tool_calls(spark, "/root/testdata/sf0.01").collect()
    assert {x["order_step"] for x in r} >= {0, 1, 2} and {x["cyclic"] for x in r} >= {True, False} and any(x["order_turn"] != x["turn"] for x in r if x["turn"] is not None)
    assert {x["fault"] for x in r} >= {None, "$.text: length", "$.even: enum", "$.length: range"} and {x["status"] for x in r} >= {"linked", "unanswered", "orphan"}


def test_calls_in_messages(spark):
    m = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":"{\\"x\\":1}"}]}'), (1, 2, "tool", '{"tool_call_id":"a","content":"1"}'), (1, 3, "assistant", None), (None, None, None, None)]
    c, got = toolcalls.calls_in(spark.createDataFrame(m, "conv_id long, turn long, role string, text string"))
    out = [r for r in toolcalls.linked(c, got, SCHEMAS).collect() if r["conv_id"]]
    assert [(r["status"], r["fault"], r["result_turn"]) for r in out] == [("linked", None, 2)]


def test_schema_faults():
    ok = lambda v, s: toolcalls.fault(v, s)
    assert ok(1, {"type": "integer"}) is None and ok(True, {"type": "integer"}) == "$: type" and ok(1.5, {"type": ["integer", "null"]}) == "$: type" and ok(None, {"type": ["integer", "null"]}) is None
    assert ok("ab", {"minLength": 3}) == "$: length" and ok([1, "a"], {"items": {"type": "string"}}) == "$[0]: type" and ok([1], {"minItems": 2}) == "$: items" and ok("x", {"enum": ["y"]}) == "$: enum"
    assert toolcalls.canonical({"b": [1.0, 2.5, 1e300], "a": None}) == '{"a":null,"b":[1,2.5,1e+300]}'


SCHEMA_CASES = [
    # schema, values that fit, (value, fault)
    (True, [1, None], []), (False, [], [(1, "$: not allowed")]), ({"properties": {"a": True, "b": False}}, [{"a": 1}, 3], [({"b": 1}, "$.b: not allowed")]),
    ({"const": {"x": 1.0}}, [{"x": 1}], [({"x": 2}, "$: const")]), ({"pattern": "^a+$"}, ["aa", 4], [("ab", "$: pattern")]), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 7], [(4, "$: anyOf")]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 9], [(6, "$: oneOf"), (7, "$: oneOf")]), ({"allOf": [{"minLength": 2}, {"maxLength": 3}]}, ["ab"], [("a", "$: length"), ("abcd", "$: length")]), ({"not": {"type": "null"}}, [1], [(None, "$: not")]),
    ({"items": [{"type": "integer"}, {"type": "string"}], "additionalItems": False}, [[1, "x"], [1], []], [(["x"], "$[0]: type"), ([1, "x", 2], "$[2]: not allowed")]), ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[1, "a", "b"]], [([1, 2], "$[1]: type")]),
    ({"exclusiveMinimum": 0, "exclusiveMaximum": 1}, [0.5], [(0, "$: range"), (1, "$: range")]), ({"multipleOf": 0.1}, [0.3, 1], [(0.35, "$: multiple")]), ({"uniqueItems": True}, [[1, "1", True]], [([1, 1.0], "$: unique")]),
    ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{"x1": 1, "y": "s"}], [({"x1": "s"}, "$.x1: type"), ({"y": 1}, "$.y: type")]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [({}, "$: properties")]),
    ({"$defs": {"n": {"type": "integer"}, "t": {"properties": {"next": {"$ref": "#/$defs/t"}, "v": {"$ref": "#/$defs/n"}}}}, "$ref": "#/$defs/t"}, [{"next": {"v": 1}}], [({"next": {"next": {"v": "x"}}}, "$.next.next.v: type")]),
    ({"title": "t", "format": "date", "default": 3}, ["anything"], []),
]


@pytest.mark.parametrize(("s", "good", "bad"), SCHEMA_CASES)
def test_schema_keywords(s, good, bad):
    toolcalls.checked(s)
    assert [toolcalls.fault(v, s) for v in good] == [None] * len(good) and [toolcalls.fault(v, s) for v, _ in bad] == [f for _, f in bad]


@pytest.mark.parametrize("s", [{"contains": {}}, {"properties": {"a": {"dependentRequired": {}}}}, {"type": "int"}, {"pattern": "("}, {"items": [3]}, {"$ref": "#/none"}, {"$ref": "other.json"}, {"$defs": {"a": {"$ref": "#/$defs/a"}}}, {"minimum": "1"}, {"multipleOf": 0}, {"anyOf": {}}, 3])
def test_unknown_schemas_are_refused(s):
    with pytest.raises(ValueError):
        toolcalls.checked(s)


def test_limits_of_arguments_are_parameters():
    deep, long = "[" * 30 + "]" * 30, "-" + "9" * 50
    assert toolcalls.parsed(deep) and toolcalls.parsed(long) == int(long)
    for text, limits in ((deep, {"depth": 29}), (long, {"digits": 49})):
        with pytest.raises(toolcalls.Fault):
            toolcalls.parsed(text, **limits)
    assert toolcalls.parsed(deep, depth=30) and toolcalls.parsed(long, digits=50)

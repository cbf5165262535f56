import json

import pytest
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.plans import flows
from verdigris.sources import diff, reports, rust
from verdigris.sources.store import Store
from verdigris.streaming.history import follow


def _text(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_diff(spark, rows):
    body = "diff --git a/app/main.py b/app/main.py\n--- a/app/main.py\n+++ b/app/main.py\n@@ -7 +7 @@\n-x\n+y\n@@ -31,0 +32,2 @@ def f(a=-1)\n+a\n+b\n@@ -44,3 +47,0 @@\n-q\n-r\n-s\n"
    gone = "--- a/app/old.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    new = "--- /dev/null\n+++ b/app/new.py\t2031\n@@ -0,0 +1,2 @@\n+a\n+b\n"
    assert rows(diff.hunks(_text(spark, body)), "file", "old_start", "old_count") == [("app/main.py", 31, 0), ("app/main.py", 44, 3), ("app/main.py", 7, 1)]
    assert rows(diff.touched_lines(diff.hunks(_text(spark, body))), "line") == [(31,), (32,), (44,), (45,), (46,), (7,)]
    assert rows(diff.hunks(_text(spark, gone, new, "@@ -1 +1 @@\n", "--- a/x\n+++ b/b/x\n@@ bad @@\n@@ -5 +5 @@")), "doc_id", "file", "old_start", "old_count") == [(0, "app/old.py", 1, 2), (1, "app/new.py", 0, 0), (3, "b/x", 5, 1)]


def test_lines_of_a_hunk_name_no_file(spark, rows):
    sql = "--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,4 @@\n select 1\n--- old note\n+++ new note\n+-- more\n\n@@ -9,2 +10 @@\n--- gone\n-x\n+y\n--- a/z.txt\n+++ b/z.txt\n@@ -4 +4 @@\n-- a\n++ b\n\\ No newline at end of file\n"
    assert rows(diff.hunks(_text(spark, sql)), "file", "old_start", "old_count") == [("q.sql", 1, 3), ("q.sql", 9, 2), ("z.txt", 4, 1)]
    short = "--- a/x\n+++ b/x\n@@ -1,5 +1,5 @@\n-a\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -2 +2 @@\n-a\n+b\n"
    assert rows(diff.hunks(_text(spark, short)), "file", "old_start", "old_count") == [("x", 1, 5), ("y", 2, 1)]


def test_changed_files(spark, rows):
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(diff.changed_files(one("b", "a", " "), one("a", "c"))) == [("a",), ("b",), ("c",)]
    assert rows(diff.changed_files(one("b", "b"))) == [("b",)]


XML = """<?xml version="1.0" encoding="UTF-8"?><!-- <testcase name="no"/> -->
<testsuites name="all"><testsuite name="shop"><testcase name="cart::adds" time="1.25"/><testcase name="cart::pays &gt; 0" time=".0075"><error message="a > b"><![CDATA[<testcase name="no"/>]]></error></testcase>
<testsuite name="shop-slow"><properties><property name="p"/></properties><testsuite><testcase name="twice" time="3"><rerunFailure/></testcase></testsuite><testcase name="mixed"><failure/><flakyError/></testcase></testsuite>
<testcase name="last" time="n/a"><skipped/></testcase></testsuite><testsuite><testcase name="bare" time="0.1"><system-out>x</system-out></testcase></testsuite></testsuites>"""


def test_outcomes(spark, rows):
    got = {r["id"]: (r["passed"], r["flaky"], r["duration_ms"]) for r in reports.outcomes(_text(spark, XML)).collect()}
    assert got == {
        "shop::cart::adds": (True, False, 1250), "shop::cart::pays > 0": (False, False, 8), "shop-slow::twice": (True, True, 3000), "shop-slow::mixed": (False, False, None),
        "shop::last": (True, False, None), "bare": (True, False, 100),
    }
    assert reports.outcomes(_text(spark, "<testsuites></testsuites>")).count() == 0
    assert rows(reports.outcomes(_text(spark, '<testsuite><testcase name="a" time="1"/></testsuite>'))) == [("a", True, False, 1000)]
    deep = "<testsuite name='s'>" * 2000 + '<testcase name="a"/>' + "</testsuite>" * 2000
    assert rows(reports.outcomes(_text(spark, deep)), "id") == [("s::a",)]
    for bad in ("<testsuites><testsuite", "", "<a><b></a></b>"):
        with pytest.raises(Exception):
            reports.outcomes(_text(spark, bad)).collect()


def _export(*regions, names=("app.cc",)):
    return json.dumps({"data": [{"functions": [{"filenames": list(names), "regions": list(regions)}]}]})


def test_coverage(spark, rows):
    got = lambda text, **k: rows(reports.covered_lines(_text(spark, text), ["doc_id"], **k), "line")
    assert got(_export([11, 5, 13, 2, 4, 0, 0, 0], [12, 1, 12, 7, 9, 0, 0, 0], [20, 1, 21, 3, 0, 0, 0, 0], [30, 1, 30, 2, 2, 0, 0, 1])) == [(11,), (12,), (13,)]
    huge = _export([40, 1, 9 * 10**18, 3, 2, 0, 0, 0], [41, 1, 2**64 - 1, 3, 2, 0, 0, 0], [42, 2, 43, 1, 6, 0, 0, 0], [50, 1, 51, 1, 6, 0, 3, 0])
    assert got(huge) == [(42,), (43,)] and got(huge, lenient=False) == []
    assert got('{"data":[]}') == [] and got("{}") == [] and got(_export([5, 1, 5, 9, 1, 7, 0, 0], [5, 1], [7, 1, 6, 1, 1, 0, 0, 0])) == []
    c = spark.createDataFrame([("t", "/ws/a.rs", 1, None), ("t", "/wsx/b.rs", 1, None)], schemas.COVERAGE)
    assert rows(reports.relative(c, "/ws/"), "file") == [("a.rs",)]
    assert spark.range(1).select(reports.relative_path(F.lit("/ws/a\\b.rs"), "/ws")).first()[0] == "a/b.rs"


def test_runs(spark, rows):
    a, b = '{"id":"a","passes":1,"fails":2}', '{"id":"a","passes":3,"fails":0}'
    for text in (f"{a}\n\n{b}\n", f" \n[{a}, {b}]"):
        assert rows(reports.runs(_text(spark, text))) == [("a", 1, 2), ("a", 3, 0)]
    assert reports.runs(_text(spark, "", "[]")).count() == 0
    for bad in ('{"id":"a","passes":1}', f"{a}\n{{oops", '[{"passes":1,"fails":1}]'):
        with pytest.raises(Exception):
            reports.runs(_text(spark, bad)).collect()


def test_metadata(spark, rows):
    package = lambda k, name, folder, *deps: {"id": k, "name": name, "manifest_path": f"{folder}/Cargo.toml", "dependencies": [{"name": d} for d in deps]}
    doc = {"workspace_root": "/home/me/shop", "workspace_members": ["shop 1", "till 1", "ledger 2"], "packages": [
        package("till 1", "till", "/home/me/shop/parts/till", "ledger", "rand", "ledger", "shop"), package("rand 9", "rand", "/cache/rand", "ledger"),
        package("ledger 2", "ledger", "/home/me/shop/parts/ledger"), package("shop 1", "shop", "/home/me/shop", "till", "time")]}
    members, edges = reports.metadata(_text(spark, json.dumps(doc)))
    assert rows(members) == [("ledger", "/home/me/shop/parts/ledger"), ("shop", "/home/me/shop"), ("till", "/home/me/shop/parts/till")]
    assert rows(edges) == [("shop", "till"), ("till", "ledger"), ("till", "shop")]


def test_listings(spark, rows):
    lines = spark.createDataFrame([("a::b: test",), ("c: benchmark",), ("2 tests, 0 benchmarks",), ('{"reason":"compiler-artifact","profile":{"test":true},"executable":"/x"}',), ('{"reason":"compiler-artifact","profile":{"test":true},"executable":null}',)], "line string")
    assert rows(reports.test_names(lines)) == [("a::b",)] and rows(reports.test_binaries(lines)) == [("/x",)]
    ids = spark.createDataFrame([("abc123",), ("xyz",), ("",), ("a" * 65,), (None,)], "x string")
    assert [r[0] for r in ids.select(reports.is_object_id(F.col("x"))).collect()] == [True, False, False, False, False]


def test_files(spark, rows, tmp_path):
    (tmp_path / "s/src").mkdir(parents=True)
    (tmp_path / "s/src/lib.rs").write_text("fn é() {}\n")
    (tmp_path / "s/README.md").write_text("x")
    assert rows(rust.read_sources(spark, str(tmp_path / "s"))) == [("src/lib.rs", "fn é() {}\n")]
    (tmp_path / "d.diff").write_text("--- a/x\n+++ b/x\n@@ -1 +1 @@\n")
    assert rows(diff.read(spark, str(tmp_path / "d.diff")), "file") == [("x",)]
    (tmp_path / "o.xml").write_text(XML)
    assert reports.read_outcomes(spark, str(tmp_path / "o.xml")).count() == 6
    (tmp_path / "r.jsonl").write_text('{"id":"a","passes":1,"fails":2}\n')
    assert rows(reports.read_runs(spark, str(tmp_path / "r.jsonl"))) == [("a", 1, 2)]


def test_pointers_are_never_missing(spark, tmp_path):
    from verdigris.storage import get_text, put_text

    path = f"file://{tmp_path}/p/NOW"
    assert get_text(spark, path) is None
    for k in range(4):
        put_text(spark, path, f"text {k}")
        assert get_text(spark, path) == f"text {k}"
    (tmp_path / "p/NOW.aside-1").write_text("a part")  # what a crash before the rename leaves
    assert get_text(spark, path) == "text 3" and {x.name for x in (tmp_path / "p").glob("NOW.?")} == {"NOW.3", "NOW.4"}
    (tmp_path / "p/NOW.5").write_text("another's")
    put_text(spark, path, "mine")
    assert get_text(spark, path) == "mine"


def test_store(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.load("history").count() == 0 and store.version() == {}
    crates = spark.createDataFrame([("a",), ("b",)], "crate string")
    prints = spark.createDataFrame([("a", "1"), ("b", "2")], "crate string, fingerprint string")
    run = lambda ok: spark.createDataFrame([("a::t", ok, False, 5), ("b::t", True, False, None)], schemas.OUTCOMES)
    assert dict(rows(flows.ingest(store, crates, run(True), prints, 1))) == {"a": True, "b": True}
    flows.ingest(store, crates, run(False), prints, 2)
    assert rows(store.load("greens")) == [("b", "2", 2)] and store.version() == {"greens": 2, "history": 2}
    assert {r["id"]: (r["passes"], r["fails"], r["last_fail"], r["recent"]) for r in store.load("history").collect()} == {"a::t": (1, 1, 2, [True, False]), "b::t": (2, 0, None, [True, True])}
    flows.ingest_status(store, crates, True, ["--nocapture"], prints, 3)
    assert rows(store.load("greens"), "crate") == [("a",), ("b",)]
    flows.ingest_coverage(store, spark.createDataFrame([("a::t", "f.rs", 1), ("a::t", "f.rs", 2)], "test_id string, file string, line int"), "r1")
    flows.ingest_coverage(store, spark.createDataFrame([("a::t", "f.rs", 3)], "test_id string, file string, line int"), "r2")
    assert rows(store.load("coverage")) == [("a::t", "f.rs", 3, "r2")]


def test_flow(spark, rows, tmp_path):
    members = spark.createDataFrame([("core", "crates/core"), ("cli", "crates/cli")], schemas.MEMBERS)
    edges = spark.createDataFrame([("cli", "core")], schemas.EDGES)
    files = spark.createDataFrame([("core", "a.rs", "d1"), ("cli", "b.rs", "d2")], "crate string, rel string, digest string")
    store = Store(spark, str(tmp_path / "store"))
    plan = flows.affected(members, edges, spark.createDataFrame([("crates/core/a.rs",)], "path string"))
    prints = flows.crate_fingerprints(files, members, edges, "d")
    assert dict(rows(flows.crates_to_run(plan, members, files, edges, store, "d"))) == {"core": True, "cli": True}
    flows.ingest(store, members.select(F.col("name").alias("crate")), spark.createDataFrame([("core::t", True, False, 1), ("cli::t", False, False, 1)], schemas.OUTCOMES), prints, 1)
    assert dict(rows(flows.crates_to_run(plan, members, files, edges, store, "d"))) == {"core": False, "cli": True}
    top = flows.dashboard_rows(plan, prints, store)[1].first()
    assert (top["cached_count"], top["affected_count"], top["always_fail_count"]) == (1, 2, 1)
    none = flows.affected(members, edges, spark.createDataFrame([("README",)], "path string"))
    assert flows.crates_to_run(none, members, files, edges, store, "d").count() == 0
    items, aliases = rust.items_and_aliases(spark.createDataFrame([("a.rs", "fn f() {\n 1;\n}\n")], "file string, src string"))
    flows.ingest_coverage(store, spark.createDataFrame([("core::t", "a.rs", 2), ("cli::t", "b.rs", 1), ("cli::u", "b.rs", 1)], "test_id string, file string, line int"), "r")
    tests = spark.createDataFrame([("core::t",), ("cli::t",), ("cli::u",)], "test_id string")
    hunks = spark.createDataFrame([("a.rs", 2, 1)], schemas.HUNKS)
    assert dict(rows(flows.functions_to_run(items, aliases, hunks, tests, store, "r"))) == {"core::t": True, "cli::t": False, "cli::u": False}
    assert flows.covered_of(tests.limit(1), store).count() == 1


def test_stream(spark, rows, tmp_path):
    seen = spark.createDataFrame([("a", k, k, k != 2, k) for k in range(4)], schemas.OBSERVED)
    seen.where("ord < 2").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for part in (None, seen.where("ord >= 2")):
        if part is not None:
            part.write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    assert rows(store.load("history")) == [("a", 3, 1, 2, 3, [True, True, False, True])]


def test_sources_read_by_one_task_are_parsed_by_many(spark, rows):
    src = spark.createDataFrame([(f"f{k}.rs", f"use a::b as c{k};\nfn f{k}() {{}}\n") for k in range(200)], "file string, src string").coalesce(1)
    items, aliases = rust.items_and_aliases(src)
    assert len(items.inputFiles()) > 4, "a file a task that parsed something"
    assert rows(items, "file", "pos", "name") == sorted([(f"f{k}.rs", 0, "") for k in range(200)] + [(f"f{k}.rs", 1, f"f{k}") for k in range(200)], key=repr)
    assert items.select("item_id").distinct().count() == 400 and aliases.count() == 200

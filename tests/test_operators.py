import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.operators import attribution, dashboard, fingerprint, fnselect, graph, history, hybrid, ordering, refgraph, selection, tune
from verdigris.sources import rust


@pytest.fixture(scope="module")
def ws(spark):
    members = spark.createDataFrame([(n, f"/ws/crates/{n}") for n in ("util", "core", "app", "cli")], schemas.MEMBERS)
    return members, spark.createDataFrame([("core", "util"), ("app", "core"), ("cli", "core"), ("core", "serde")], schemas.EDGES)


def test_affected(spark, rows, ws):
    e = graph.resolved(ws[1], ws[0])
    for seed, want in (("util", "app cli core util"), ("app", "app"), ("core", "app cli core")):
        assert [r[0] for r in rows(graph.affected(e, spark.createDataFrame([(seed,)], "crate string")))] == want.split()
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], schemas.EDGES)
    assert [r[0] for r in rows(graph.affected(loop, spark.createDataFrame([("a",), (None,)], "crate string")))] == ["a", "b", "c"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=20), st.sets(st.integers(0, 8), min_size=1, max_size=3))
def test_closures_are_sound(spark, edges, seeds):
    def walk(first):
        want, todo = set(first), list(first)
        while todo:
            todo = [b for x in todo for a, b in edges if a == x and b not in want and not want.add(b)]
        return want

    s = spark.createDataFrame([(x,) for x in seeds], "node long")
    got = graph.reachable(spark.createDataFrame(edges, "s long, d long"), s, "s", "d")
    assert {r[0] for r in got.collect()} == walk(seeds) and got.count() == len(walk(seeds))
    pairs = fingerprint.closure_pairs(spark.createDataFrame(edges, "crate long, dep long"), s)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((a, b) for a in seeds for b in walk([a]))


def test_a_long_chain_is_walked(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(75)], "s long, d long")
    assert graph.reachable(e, spark.createDataFrame([(3,)], "node long"), "s", "d").count() == 73


def test_owned_paths(spark, rows):
    members = spark.createDataFrame([("outer", "/ws"), ("inner", "/ws/crates/inner"), ("twin", "/ws/crates/inner/")], schemas.MEMBERS).withColumn("pos", F.monotonically_increasing_id())
    files = spark.createDataFrame([(x,) for x in ("/ws/crates/inner/src/lib.rs", "/ws/build.rs", "/elsewhere/x.rs", "/ws/crates/innermost/x.rs", "/ws2/a", "/ws")], "path string")
    assert dict(rows(graph.owned_paths(files, members), "path", "owner")) == {"/ws/crates/inner/src/lib.rs": "inner", "/ws/build.rs": "outer", "/elsewhere/x.rs": None, "/ws/crates/innermost/x.rs": "outer", "/ws2/a": None, "/ws": "outer"}


def test_owned_tests(spark, rows):
    crates = spark.createDataFrame([("my-crate",), ("my",), ("my_crate",), ("my-crate::sub",)], "crate string")
    ids = spark.createDataFrame([("my_crate::tests::bad",), ("my::x",), ("my_crate::sub::y",), ("mycrate::z",), ("my",)], "id string")
    assert dict(rows(graph.owned_tests(ids, crates), "id", "owner")) == {"my_crate::tests::bad": "my_crate", "my::x": "my", "my_crate::sub::y": "my-crate::sub", "mycrate::z": None, "my": "my"}


@pytest.mark.parametrize(("changed", "every", "changed_crates", "affected", "ignored"), [
    ("crates/core/src/lib.rs", False, ["core"], ["cli", "core"], 0), ("README.md", False, [], [], 1), ("Cargo.lock", True, [], ["cli", "core", "util"], 0),
    ("crates/util/src/lib.rs", False, ["util"], ["cli", "core", "util"], 0), ("crates/util/Cargo.toml", False, ["util"], ["cli", "core", "util"], 0), ("crates/utility/x.rs", False, [], [], 1),
])
def test_plan(spark, changed, every, changed_crates, affected, ignored):
    members = spark.createDataFrame([(n, f"/ws/crates/{n}") for n in ("util", "core", "cli")], schemas.MEMBERS)
    edges = spark.createDataFrame([("core", "util"), ("cli", "core")], schemas.EDGES)
    p = selection.plan(members, edges, spark.createDataFrame([(changed,), ("  ",)], "path string"), "/ws")
    s, status = p.summary.first(), {r["crate"]: r["status"] for r in p.crates.collect()}
    assert (s["select_all"], s["ignored_files"]) == (every, ignored)
    assert sorted(c for c, x in status.items() if x == "changed") == changed_crates
    assert sorted(c for c, x in status.items() if x != "skipped") == affected == sorted(r[0] for r in p.selected().collect())
    assert p.is_empty() == (not affected) and s["changed"] + s["affected"] + s["skipped"] == 3
    assert ('"select_all":true' in p.as_json().first()[0]) == every and p.as_text().count("\n") == 3


def test_history(spark, rows):
    seen = [("t", k, 100 + k, k % 10 != 3, k if k % 2 else None) for k in range(70)] + [("u", 1, 1, True, 10), ("u", 2, 2, False, 12)]
    h = {r["id"]: r for r in history.fold(spark.createDataFrame(seen, schemas.OBSERVED)).collect()}
    assert len(h["t"]["recent"]) == 50 and h["t"]["recent"] == [k % 10 != 3 for k in range(20, 70)]
    assert (h["t"]["passes"], h["t"]["fails"], h["t"]["last_fail"], h["t"]["last_duration_ms"]) == (63, 7, 163, 69)
    assert (h["u"]["passes"], h["u"]["fails"], h["u"]["last_fail"], h["u"]["last_duration_ms"], h["u"]["recent"]) == (1, 1, 2, 12, [True, False])
    cut = [spark.createDataFrame(x, schemas.OBSERVED) for x in (seen[:30], seen[30:])]
    assert rows(history.merged(*map(history.fold, cut))) == rows(history.fold(spark.createDataFrame(seen, schemas.OBSERVED)))


def _past(spark, rows):
    return spark.createDataFrame(rows, schemas.HISTORY)


def test_fail_fast_order(spark):
    def order(names, past):
        ranks = ordering.fail_fast_rank(spark.createDataFrame([(n,) for n in names], "id string"), _past(spark, past)).collect()
        return [r["id"] for r in sorted(ranks, key=lambda r: r["rank"])]

    assert order(["slow_green", "fast_flaky"], [("slow_green", 10, 0, None, 500, [True, True]), ("fast_flaky", 8, 2, 100, 20, [True, False])]) == ["fast_flaky", "slow_green"]
    assert order(["old", "new"], [("old", 1, 1, 100, 10, [False]), ("new", 1, 1, 900, 10, [False])]) == ["new", "old"]
    assert order(["a", "b"], [("a", 5, 0, None, 300, [True]), ("b", 5, 0, None, 50, [True])]) == ["b", "a"]
    assert order(["z", "a", "m", "a"], []) == ["a", "a", "m", "z"]
    assert order(["p", "q"], [("p", 5, 1, None, 1, [True]), ("q", 5, 1, 7, 900, [True])]) == ["q", "p"]


def test_bisect(spark):
    for n, first in ((8, 3), (8, 0), (8, 7), (1024, 700)):
        calls = []
        assert ordering.bisect(n, lambda i, first=first, calls=calls: calls.append(i) or i >= first) == first
        assert len(calls) <= 12
    assert ordering.bisect(8, lambda i: False) is None and ordering.bisect(0, lambda i: True) is None
    assert ordering.first_failing(spark.range(10), "id", "id >= 4").first()[0] == 4
    assert ordering.first_failing(spark.range(10), "id", "id > 40").first()[0] is None


def test_attribution(spark, rows):
    def got(crates, seen):
        return dict(rows(attribution.crate_results(spark.createDataFrame([(c,) for c in crates], "crate string"), spark.createDataFrame([(i, p, False, None) for i, p in seen], schemas.OUTCOMES))))

    assert got(["one-core", "one"], [("one-core::graph::ok", True), ("one-core::select::bad", False), ("one::main::ok", True)]) == {"one-core": False, "one": True}
    assert got(["a", "b"], [("a::x", True)]) == {"a": True, "b": None}
    assert got(["my-crate"], [("my_crate::tests::bad", False), ("my_crate::t", True)]) == {"my-crate": False}
    one = spark.createDataFrame([("a",)], "crate string")
    assert [rows(attribution.aggregate_results(one, *x))[0][1] for x in ((True, True), (True, False), (False, False))] == [True, None, False]
    assert attribution.is_exhaustive(["--nocapture"]) and not attribution.is_exhaustive(["--skip"]) and not attribution.is_exhaustive(["name"])


def test_cache_and_greens(spark, rows):
    crates = spark.createDataFrame([("a",), ("b",), ("c",)], "crate string")
    prints = spark.createDataFrame([("a", "1"), ("b", "2")], "crate string, fingerprint string")
    greens = spark.createDataFrame([("a", "1", 5), ("b", "old", 5), ("c", "", 5)], schemas.GREENS)
    assert dict(rows(attribution.to_run(crates, prints, greens))) == {"a": False, "b": True, "c": True}
    assert dict(rows(attribution.to_run(crates, prints, greens, no_cache=True))) == {"a": True, "b": True, "c": True}
    done = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "crate string, passed boolean")
    assert rows(history.with_greens(greens, done, prints, 9)) == [("b", "2", 9), ("c", "", 5)]


@pytest.mark.parametrize("how", [fingerprint.fingerprints, fingerprint.merkle])
def test_fingerprints(spark, rows, how):
    edges = spark.createDataFrame([("core", "util"), ("cli", "core")], schemas.EDGES)

    def prints(util="u", cli="x", scope="d"):
        return dict(rows(how(spark.createDataFrame([("util", util), ("core", "c"), ("cli", cli)], "crate string, digest string"), edges, scope)))

    base = prints()
    assert prints() == base and len(set(base.values())) == 3
    changed = lambda other: {k for k in base if base[k] != other[k]}
    assert changed(prints(util="v")) == {"util", "core", "cli"} and changed(prints(cli="y")) == {"cli"} and changed(prints(scope="e")) == {"util", "core", "cli"}


def test_fingerprints_cover_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], schemas.EDGES)
    got = [dict(rows(f(spark.createDataFrame([("a", x), ("b", "1"), ("c", "1"), ("d", "1")], "crate string, digest string"), edges, "s"))) for f in (fingerprint.fingerprints, fingerprint.merkle) for x in "12"]
    for x, y in (got[:2], got[2:]):
        assert {k for k in x if x[k] != y[k]} == {"a", "b", "c"}


def test_tree_digests(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / ".git").mkdir()
    for name, text in (("src/lib.rs", "x"), ("target/out", "y"), (".git/HEAD", "z"), (".hidden", "h"), ("src/data.bin", "b")):
        (tmp_path / name).write_text(text)
    (tmp_path / "link").symlink_to("src")
    files = rust.tree_files(spark, str(tmp_path))
    assert {r["rel"] for r in files.collect()} == {"src/lib.rs", "src/data.bin", ".hidden", "link"}
    own = lambda: fingerprint.own_digests(rust.tree_files(spark, str(tmp_path)).withColumn("crate", F.lit("c"))).first()["digest"]
    a = own()
    (tmp_path / "target/out").write_text("changed")
    assert own() == a
    (tmp_path / "src/data.bin").write_text("changed")
    assert own() != a


def test_function_selection(spark, rows):
    impacts = spark.createDataFrame([("src/lib.rs", False, k) for k in range(5, 9)], schemas.IMPACTS)
    coverage = spark.createDataFrame([("t_b", "src/lib.rs", 6, "x"), ("t_a", "src/lib.rs", 2, "x"), ("t_x", "src/other.rs", 1, "x")], schemas.COVERAGE)
    tests = spark.createDataFrame([(t,) for t in ("t_a", "t_b", "t_x", "t_new")], "test_id string")
    assert dict(rows(fnselect.select(impacts, coverage, tests))) == {"t_a": False, "t_b": True, "t_x": False, "t_new": True}
    assert dict(rows(fnselect.select(impacts.limit(0), coverage, tests))) == {"t_a": False, "t_b": False, "t_x": False, "t_new": True}
    whole = spark.createDataFrame([("src/zzz.rs", True, None)], schemas.IMPACTS)
    assert all(r["must_run"] for r in fnselect.select(whole, coverage, tests).collect())
    assert all(r["must_run"] for r in fnselect.select(impacts, coverage, tests, base="other").collect())
    past = _past(spark, [("t_x", 1, 1, 1, 1, [True]), ("t_a", 5, 0, None, 1, [True])])
    assert dict(rows(fnselect.with_flaky(fnselect.select(impacts, coverage, tests), past)))["t_x"]


SOURCE = """const LIMIT: u32 = 10;
const DERIVED: u32 = LIMIT + 1;
fn uses_limit() -> u32 {
    LIMIT // { " '
}
fn uses_derived() -> u32 {
    DERIVED
}
fn unrelated() -> u32 {
    1
}
struct S { x: u32 }
"""


def _items(spark, **files):
    return rust.items_and_aliases(spark.createDataFrame([(f"{k}.rs", v) for k, v in files.items()], "file string, src string"))


def test_references(spark):
    items, aliases = _items(spark, a=SOURCE, b="use crate::LIMIT as CAP;\n\nfn check() -> bool {\n    1 < CAP\n}\n", c="use crate::other as CAP;\nimpl S {\n    fn method(&self) { CAP; }\n}\n")
    seed = items.where("name = 'LIMIT'").select("item_id")
    used = refgraph.users(items, refgraph.reference_edges(items, aliases), seed)
    assert {(r["file"], r["start"]) for r in used.collect()} == {("a.rs", 3), ("a.rs", 6), ("b.rs", 3), ("c.rs", 3)}
    lines = spark.createDataFrame([("a.rs", k) for k in (4, 1, 12, 13)], "file string, line int")
    name = {r["item_id"]: r["name"] for r in items.collect()}
    fn, other = ({r["line"]: name.get(r["item_id"]) for r in refgraph.enclosing(lines, items, f).collect()} for f in (True, False))
    assert fn == {4: "uses_limit", 1: None, 12: None, 13: None} and other == {4: None, 1: "LIMIT", 12: "S", 13: None}


def test_lexer():
    items, aliases = rust.parse('''#![allow(x)]
/* fn no() { /* nested */ */
pub(crate) const fn cf<'a>(x: &'a str) -> char { '}' }
pub static mut COUNT: [u8; 2] = [1, 2];
type Alias<T> = Vec<T>;
pub trait Shape { const N: u8 = 1; fn area(&self) -> f64; fn name(&self) -> String { r#"a " } fn x() {"#.into() } }
impl<T: Into<u8>> Shape for Box<T> { const K: u8 = 2; type Out = u8; fn area(&self) -> f64 { 0.0 } }
mod inner { pub(super) async unsafe fn deep() {} }
mod other;
#[derive(Debug)]
pub struct Pair(u8, u8);
enum E { A { x: u8 }, B }
macro_rules! m { () => { fn hidden() {} } }
use a::{b as c, d::{self, E as F}};
extern "C" fn ffi() {}
thread_local!(static X: u8 = 1);
''')
    assert [(n, k, a, b) for n, k, a, b, _ in items] == [
        ("cf", "fn", 1, 3), ("COUNT", "static", 4, 4), ("Alias", "type_alias", 5, 5), ("Shape", "opaque", 6, 6), ("name", "fn", 6, 6), ("Box", "opaque", 7, 7), ("K", "const", 7, 7), ("Out", "type_alias", 7, 7),
        ("area", "fn", 7, 7), ("deep", "fn", 8, 8), ("", "opaque", 9, 9), ("Pair", "opaque", 10, 11), ("E", "opaque", 12, 12), ("", "opaque", 13, 13), ("", "opaque", 14, 14), ("ffi", "fn", 15, 15), ("", "opaque", 16, 16),
    ]
    assert aliases == [("c", "b"), ("F", "E")]
    assert rust.parse("fn broken( {") == ([], [])
    assert rust.parse("fn r#match() { r#type(r#\"x\"#); }")[0] == [("r#match", "fn", 1, 1, ["fn", "r#match", "r#type"])]
    deep = rust.parse("mod m { fn f() {} " * 3000 + "}" * 3000)[0]
    assert len(deep) == 3000 and {x[1] for x in deep} == {"fn"}


def test_equally_small_items_give_the_first_of_the_file(spark):
    items, _ = _items(spark, **{f"f{k}": "const ONE: u8 = 1; const TWO: u8 = ONE;\nfn a() {} fn b() {}\n" for k in range(12)})
    lines = spark.createDataFrame([(f"f{k}.rs", n) for k in range(12) for n in (1, 2)], "file string, line int")
    name = {r["item_id"]: r["name"] for r in items.collect()}
    got = {(r["line"], name.get(r["item_id"])) for f in (True, False) for r in refgraph.enclosing(lines, items, f).collect()}
    assert got == {(1, "ONE"), (2, "a"), (1, None), (2, None)}


def test_hybrid(spark):
    src = "const LIMIT: u32 = 10;\nfn uses_limit() {\n  LIMIT;\n}\nfn unrelated() {\n  1;\n}\nstruct S { x: u32 }\n"
    items, aliases = _items(spark, lib=src)

    def got(*hunks):
        x = hybrid.analyze(items, aliases, spark.createDataFrame([("lib.rs", *h) for h in hunks], schemas.HUNKS))
        return x.whole_crate, {r["line"] for r in x.lines.collect()}

    assert got((1, 1)) == (False, {2, 3, 4})
    assert got((6, 1)) == (False, {5, 6, 7})
    assert got((8, 1)) == (True, set()) and got((1, 1), (8, 1)) == (True, set()) and got((0, 0))[0]
    assert got((6, 0)) == (False, {5, 6, 7})
    x = hybrid.analyze(items, aliases, spark.createDataFrame([], schemas.HUNKS))
    assert not x.whole_crate and not x.lines.count()


def test_dashboard(spark):
    status = spark.createDataFrame([("core", "changed"), ("cli", "affected"), ("old", "skipped")], "crate string, status string")
    prints = spark.createDataFrame([("core", "abcdef0123456789"), ("cli", "1111222233334444")], "crate string, fingerprint string")
    greens = spark.createDataFrame([("cli", "1111222233334444", 1), ("old", "", 1)], schemas.GREENS)
    past = _past(spark, [("core::t1", 1, 0, None, 20, [True]), ("core::t2", 1, 2, 5, None, [False])])
    rows = dashboard.crates(status, prints, greens, past)
    got = {r["crate"]: r for r in rows.collect()}
    assert (got["core"]["tests"], got["core"]["total_ms"], got["core"]["short_fp"]) == (2, 20, "abcdef012345")
    assert not got["old"]["cached_green"] and got["old"]["short_fp"] == ""
    h = dashboard.header(rows, past).first()
    assert (h["crate_count"], h["affected_count"], h["cached_count"], h["hit_ratio"], h["flaky_count"], h["always_fail_count"]) == (3, 2, 1, 0.5, 1, 0)
    bars = [r[0] for r in spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.44, 0.55, 2.0)], "x double").select(dashboard.bar(F.col("x"))).collect()]
    assert [b.count("█") for b in bars] == [0, 0, 4, 6, 10] and all(len(b) == 10 for b in bars)


def test_tune(spark):
    texts = ["release: 1.96.0", "x\nrelease: 1.90.0-nightly\nhost: x86_64-unknown-linux-gnu\n", "no release line", "release: 1.80"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tune.release(F.col("t")).alias("v"), tune.host(F.col("t")).alias("h"))
    assert [tuple(r["v"]) if r["v"] else None for r in df.collect()] == [(1, 96, 0), (1, 90, 0), None, (1, 80, 0)]
    linux = "x86_64-unknown-linux-gnu"
    assert [r[0] for r in df.select(tune.fast_linker_default(F.lit(linux), F.col("v"))).collect()] == [True, True, None, False]
    assert not df.select(tune.fast_linker_default(F.lit("aarch64-apple-darwin"), F.col("v"))).first()[0]
    v = lambda minor: F.struct(F.lit(1).alias("major"), F.lit(minor).alias("minor"), F.lit(0).alias("patch"))
    text = lambda host, system, version, mold, clang: spark.range(1).select(tune.build_config(F.lit(host), F.lit(system), version, F.lit(mold), F.lit(clang))).first()[0]
    assert "mold" in text(linux, "linux", v(90), True, True) and tune.NOTE in text(linux, "linux", v(90), True, True) and "mold" not in text(linux, "linux", v(80), True, False)
    none = F.lit(None).cast("struct<major:int,minor:int,patch:int>")
    assert "split-debuginfo" not in text("x", "windows", none, True, True) and tune.NOTE not in text(linux, "linux", none, True, True)
    advise = lambda *n: tune.hack_advice(spark.createDataFrame([(x,) for x in n], "name string")).first()[0]
    assert advise(*"abcd") and not advise(*"abc") and not advise("a", "b", "c", "my-workspace-hack") and advise("a", "b", "c", "workspace-hacks")

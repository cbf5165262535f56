"""Ranges of lines against lists of their lines."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import fnselect, ranges, refgraph
from verdigris.sources import reports


def made(r, n, top=200):
    out = []
    for _ in range(n):
        a = r.randrange(top)
        out.append((r.choice("xyz"), a, a + r.choice([0, 0, 1, 2, 7, 8, 50, 127, 128])))
    return out


def listed(rows):
    return {(f, k) for f, a, b in rows for k in range(a, b + 1)}


def test_union_and_pieces(spark):
    r = random.Random(1)
    rows = made(r, 60) + [("x", 5, 4), ("z", 900, 900), ("z", 901, 901)]
    df = spark.createDataFrame(rows, "file string, first int, last int")
    got = [tuple(x) for x in ranges.united(df, ["file"]).collect()]
    assert sorted((f, k) for f, a, b in got for k in range(a, b + 1)) == sorted(listed(rows)), "each line once"
    assert all(not (f == g and b + 1 == c) for f, _, b in got for g, c, _ in got), "none touch"
    for f, a, b, p in df.where("first <= last").select("file", "first", "last", ranges.pieces()).collect():
        assert sorted(k for x in p for k in range(x["block"] << x["level"], x["block"] + 1 << x["level"])) == list(range(a, b + 1)) and len(p) <= 2 * (b - a + 1).bit_length()


def test_stabbing_and_overlap(spark):
    r = random.Random(2)
    spans, points, other = made(r, 40), [(r.choice("xyzw"), r.randrange(350)) for _ in range(150)], made(r, 6, 400)
    s = spark.createDataFrame([(k, *x) for k, x in enumerate(spans)], "id int, file string, first int, last int")
    p = spark.createDataFrame(points, "file string, line int")
    got = sorted(tuple(x) for x in ranges.stabbed(p, s, ["file"]).select("file", "line", "id").collect())
    assert got == sorted((f, n, k) for f, n in points for k, (g, a, b) in enumerate(spans) if f == g and a <= n <= b)
    o = spark.createDataFrame(other, "file string, first int, last int")
    assert {x["id"] for x in ranges.overlapping(s, o, ["file"], ["id"]).collect()} == {k for k, (f, a, b) in enumerate(spans) if any(f == g and a <= d and c <= b for g, c, d in other)}
    assert ranges.stabbed(p, s.limit(0), ["file"]).count() == 0 and ranges.overlapping(s.limit(0), o, ["file"], ["id"]).count() == 0


def test_a_region_of_a_million_lines_is_a_row(spark, rows):
    export = '{"data":[{"functions":[{"filenames":["a.rs"],"regions":[[1,1,5000000,1,3,0,0,0],[4999990,1,6000000,1,1,0,0,0],[6000002,1,6000003,1,1,0,0,0],[7,1,9,1,0,0,0,0]]}]}]}'
    cover = reports.covered_ranges(spark.createDataFrame([("t", export)], "test_id string, text string"), ["test_id"])
    assert rows(cover) == [("t", "a.rs", 1, 6000000), ("t", "a.rs", 6000002, 6000003)]
    hit = lambda a, b: fnselect.covered_by(cover, spark.createDataFrame([("a.rs", a, b)], "file string, first long, last long")).count()
    assert [hit(*x) for x in ((5_500_000, 5_500_000), (6_000_001, 6_000_001), (6_000_001, 9_000_000), (0, 0))] == [1, 0, 1, 0]
    lines = spark.createDataFrame([("t", "a.rs", 77), ("u", "a.rs", 99)], "test_id string, file string, line int")
    assert rows(fnselect.covered_by(lines, spark.createDataFrame([("a.rs", 70, 80)], "file string, first int, last int"))) == [("t",)]


def test_an_item_as_long_as_its_file(spark):
    """Half a million lines in an item as long as the file and in short ones."""
    items = spark.createDataFrame([(1, "fn", "f", 0, 10_000_000, 0), (2, "fn", "f", 100_000, 200_000, 1), (3, "fn", "f", 150_000, 250_000, 2), (4, "const", "f", 0, 5, 3)], "item_id long, kind string, file string, start int, end int, pos int")
    lines = spark.range(500_000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"))
    got = dict(refgraph.enclosing(lines, items, True).groupBy("item_id").count().collect())
    assert got == {1: 349_999, 2: 100_001, 3: 50_000}


def test_what_dealing_makes_is_not_broadcast_unless_it_is_small(spark, monkeypatch):
    s = spark.range(400).selectExpr("id as item_id", "'f' as file", "id as first", "id + id % 9 as last")
    p = spark.range(300).selectExpr("'f' as file", "id as line")
    want = sorted((n, k) for k in range(400) for n in range(k, min(k + k % 9, 299) + 1))
    for most, sent in ((0, False), (300 * 4, True), (1 << 18, True)):
        monkeypatch.setattr(ranges, "SENT", most, raising=False)
        got = ranges.stabbed(p, s, ["file"])
        assert ("Broadcast" in got._jdf.queryExecution().executedPlan().toString()) == sent, "what Spark estimates before rows are dealt says nothing"
        assert sorted((r["line"], r["item_id"]) for r in got.collect()) == want


def test_overlap_deals_no_range_to_several_rows(spark, monkeypatch):
    """Ranges of one line and of millions, over chunks of lines, by what crosses an exchange."""
    monkeypatch.setattr(ranges, "dealt", lambda *x: pytest.fail("a range is a row, whatever its length"))
    r = random.Random(3)
    some = lambda n, long: [(r.choice("xyz"), a, a + r.choice([0, 1, 40, 70_000, long])) for a in (r.randrange(-(1 << 20), 1 << 20) for _ in range(n))]
    spans, other = some(300, 300_000) + [("x", 5, 4), ("w", 1, 2), ("y", None, 3)], some(6, 90_000) + [("x", 9, 1), ("x", None, 7), ("v", 0, 9)]
    s = spark.createDataFrame([(k, *x) for k, x in enumerate(spans)], "id int, file string, first int, last int")
    o = spark.createDataFrame(other, "file string, first long, last long")
    ok = lambda a, b: a is not None and a <= b
    want = sorted(k for k, (f, a, b) in enumerate(spans) if ok(a, b) and any(f == g and ok(c, d) and a <= d and c <= b for g, c, d in other))
    assert 0 < len(want) < 300
    for sent in (ranges.SENT, 0):
        monkeypatch.setattr(ranges, "SENT", sent)
        assert sorted(x["id"] for x in ranges.overlapping(s, o, ["file"], ["id"]).collect()) == want

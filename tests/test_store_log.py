"""The store's logs: what appends write, writers that meet, merges by level, streams with late outcomes and repeats."""

import random

from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.operators import history
from verdigris.sources import store as stores
from verdigris.sources.store import Store
from verdigris.streaming.history import follow


def observed(r, n, ids=7):
    return [(f"t{r.randrange(ids)}", k, 1000 + k, r.random() < 0.7, r.choice([None, k])) for k in range(n)]


def test_parts_merge_in_any_order(spark, rows):
    r = random.Random(1)
    seen = observed(r, 900)
    want = rows(history.fold(spark.createDataFrame(seen, schemas.OBSERVED)))
    r.shuffle(seen)
    parts = [history.partial(spark.createDataFrame(seen[k::6], schemas.OBSERVED)) for k in range(6)]
    r.shuffle(parts)
    both = parts[0]
    for p in parts[1:3]:
        both = both.union(p)
    both = history.together(both)
    for p in parts[3:]:
        both = both.union(p)
    assert rows(history.finished(history.together(both))) == want


def test_appends_write_only_what_is_new(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FANOUT", 3)
    s, r = Store(spark, str(tmp_path / "s")), random.Random(2)
    greens, sizes = {}, []
    for at in range(1, 6):
        changes = [(f"c{k}", r.choice([None, f"p{at}"]), at) for k in r.sample(range(6), 3)]
        greens |= {c: (p, a) for c, p, a in changes}
        s.append(greens=spark.createDataFrame(changes, schemas.GREENS))
        sizes.append(len(s.manifest()[1]["greens"]))
    assert rows(s.load("greens")) == sorted((c, p, a) for c, (p, a) in greens.items() if p) and sizes == [1, 2, 1, 2, 3]
    cover = lambda t, *lines: spark.createDataFrame([(t, "f", k, "b") for k in lines], schemas.COVERAGE)
    s.append(coverage=cover("t", 1, 2).union(cover("u", 5)))
    s.append(coverage=cover("t", 3))
    assert rows(s.load("coverage"), "test_id", "line") == [("t", 3), ("u", 5)]
    before = s.manifest()[1]
    s.save(coverage=cover("v", 9))
    assert rows(s.load("coverage"), "test_id") == [("v",)] and rows(s.load("coverage", before), "test_id", "line") == [("t", 3), ("u", 5)], "a snapshot stays"
    s.clean()
    assert rows(s.load("coverage"), "test_id") == [("v",)] and len(list((tmp_path / "s/coverage").iterdir())) == 1


def test_two_writers_both_land(spark, rows, tmp_path, monkeypatch):
    """One writer commits between the other's reading of the manifest and its commit."""
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one = lambda name: history.partial(spark.createDataFrame([(name, 0, 1, True, 1)], schemas.OBSERVED))
    real, done = a.manifest, []

    def late():
        m = real()
        if len(done) < 2:
            done.append(b.append(history=one(f"b{len(done)}")))
        return m

    monkeypatch.setattr(a, "manifest", late)
    assert a.append(history=one("a"))
    assert rows(b.load("history"), "id") == [("a",), ("b0",), ("b1",)]
    assert b.append(("stream", 4), history=one("c")) and not b.append(("stream", 4), history=one("c")) and not b.append(("stream", 3), history=one("c"))
    assert rows(b.load("history"), "id", "passes") == [("a", 1), ("b0", 1), ("b1", 1), ("c", 1)]


def test_stream_equals_one_fold(spark, rows, tmp_path):
    """Outcomes that come late, in files of one batch each, with a restart: the same as folded at once."""
    r = random.Random(5)
    seen = observed(r, 400, 4)
    want = rows(history.fold(spark.createDataFrame(seen, schemas.OBSERVED)))
    r.shuffle(seen)
    s, src = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(seen[k::3], schemas.OBSERVED).coalesce(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schemas.OBSERVED).option("maxFilesPerTrigger", 1).parquet(src)
        follow(stream, s, str(tmp_path / "ck")).awaitTermination()
    assert rows(s.load("history")) == want
    assert s.load("history").agg(F.sum("passes") + F.sum("fails")).first()[0] == 400

"""Graphs in one part and in many, with hubs, long chains and cycles, against a plain walk."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import fingerprint, graph


def plain(edges, seeds):
    """node -> least label of the seeds that reach it."""
    to, got = {}, {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    for label, node in sorted((x, n) for n, x in seeds):
        todo = [node] if node not in got else []
        while todo:
            v = todo.pop()
            if v not in got:
                got[v] = label
                todo += [u for u in to.get(v, []) if u not in got]
    return got


@pytest.mark.parametrize("size", [12, 1 << 20])
def test_spread(spark, size):
    r = random.Random(size)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(5, k) for k in range(60, 90)] + [(k, 5) for k in range(70, 75)] + [(88, 2)]
    seeds = [(k, r.randrange(5)) for k in (3, 5, 17, 17, 44, 999)] + [(5, 9)]
    got = graph.spread(spark.createDataFrame([*edges, (None, 1), (1, None)], "s long, d long"), spark.createDataFrame([*seeds, (None, 0)], "node long, label long"), size).collect()
    want = plain(edges, seeds)
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want


def test_a_small_label_overtakes_at_a_hub(spark):
    """A hub that arrives with one label and is then reached with a smaller one passes that one on to all parts."""
    edges = [("hub", f"t{k}") for k in range(40)] + [("a", "b"), ("b", "c"), ("c", "hub"), ("t7", "z")]
    seeds = [("hub", "m"), ("a", "k"), ("t3", "a")]
    got = graph.spread(spark.createDataFrame(edges, "s string, d string"), spark.createDataFrame(seeds, "node string, label string"), 12).collect()
    assert {r["node"]: r["label"] for r in got} == plain(edges, seeds)


def test_long_chains_and_cycles(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("id s", "id + 1 d")
    one = spark.createDataFrame([(0,)], "node long")
    assert graph.reachable(chain, one, "s", "d").count() == n + 1
    assert graph.reachable(chain.selectExpr("s", f"d % {n} d"), spark.createDataFrame([(77,)], "node long"), "s", "d").count() == n
    assert graph.reachable(chain.limit(0), one, "s", "d").collect() == [(0,)] and graph.reachable(chain, one.limit(0), "s", "d").count() == 0
    assert graph.reachable(spark.range(30).selectExpr("id s", "id + 1 d"), one.limit(0), "s", "d", 7).count() == 0


def components(edges, nodes):
    """node -> least node of its strongly connected component, by reachability both ways."""
    reach = {n: set(plain(edges, [(n, 0)])) for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_cycles(spark, size):
    r = random.Random(4)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(55)] + [(50, 51), (51, 50), (51, 52), (52, 53), (53, 52), (60, 60)]
    got = graph.cycles(spark.createDataFrame([*edges, (None, 3)], "s long, d long"), size).collect()
    nodes = {n for e in edges for n in e}
    assert len(got) == len(nodes) and {r["node"]: r["component"] for r in got} == components(edges, nodes)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def sealed(leaves):
    at = {}
    for h in map(sha, leaves):
        at.setdefault(h[:4], []).append(h)
    for width in (2, 0, 0):
        up = {}
        for key, hs in at.items():
            up.setdefault(key[:width], []).append(sha("\n".join(sorted(hs))))
        at = up
    return at[""][0]


def prints(digests, edges, scope):
    edges = {(a, b) for a, b in edges if a != b and a in digests and b in digests}
    of = components(edges, set(digests))
    members, got = {}, {}
    for n, c in of.items():
        members.setdefault(c, []).append(n)

    def seal(c):
        if c not in got:
            own = digests[c] if len(members[c]) == 1 else sealed(f"{m}={digests[m]}" for m in members[c])
            deps = {(b, of[b]) for a, b in edges if of[a] == c != of[b]}
            got[c] = sha("\0".join((scope, own, "\n".join(sorted(f"{b}={seal(d)}" for b, d in deps)))))
        return got[c]

    return {n: seal(of[n]) for n in digests}


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_fingerprints_by_components(spark, size):
    r = random.Random(9)
    digests = {f"c{k:02}": sha(f"d{k}") for k in range(40)}
    edges = [(f"c{max(a, b):02}", f"c{min(a, b):02}") for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(60))]
    edges += [("c05", "c06"), ("c06", "c05"), ("c20", "c31"), ("c31", "c20"), ("c11", "c30"), ("c30", "c11"), ("c07", "gone"), ("c39", "c39")]
    df = spark.createDataFrame(list(digests.items()), "crate string, digest string")
    got = fingerprint.merkle(df, spark.createDataFrame(edges, "crate string, dep string"), "s", size).collect()
    assert len(got) == 40 and {x["crate"]: x["fingerprint"] for x in got} == prints(digests, edges, "s")
    none = fingerprint.merkle(df.limit(0), spark.createDataFrame(edges, "crate string, dep string"), "s", size)
    assert none.count() == 0


def test_fingerprints_take_few_rounds_where_parts_are_many(spark, monkeypatch):
    """Crates on each other are one by a join, without a search for cycles, and a chain that fits a task ends in one task."""
    steps, write = [], fingerprint.written

    def counted(*x):
        steps.append(x[1])
        assert len(steps) < 40, "as many rounds as the chain changes parts"
        return write(*x)

    monkeypatch.setattr(fingerprint, "written", counted)
    monkeypatch.setattr(graph, "cycles", lambda *x: pytest.fail("no cycle is longer than two"))
    edges = [(f"c{k}", f"c{k + 1}") for k in range(150)] + [(f"w{k}", f"w{k % 9}") for k in range(9, 400)] + [("c70", "w20"), ("w20", "w21"), ("w21", "w20"), ("w22", "w20"), ("w20", "w22"), ("w60", "c140")]
    digests = {n: sha("d" + n) for e in edges for n in e}
    got = fingerprint.merkle(spark.createDataFrame(list(digests.items()), "crate string, digest string"), spark.createDataFrame(edges, "crate string, dep string"), "s", 400).collect()
    assert len(got) == len(digests) and {x["crate"]: x["fingerprint"] for x in got} == prints(digests, edges, "s")


def test_fingerprints_of_long_chains_and_cycles(spark):
    """A chain of 100,000 and, below it, a cycle of 10,000: what hangs on the changed one changes, and nothing else."""
    chain = spark.range(100_000).selectExpr("concat('a', id) crate", "if(id = 99999, 'b5', concat('a', id + 1)) dep")
    ring = spark.range(10_000).selectExpr("concat('b', id) crate", "concat('b', (id + 1) % 10000) dep")
    free = spark.range(5).selectExpr("concat('z', id) crate", "concat('z', id - 1) dep")
    edges = chain.union(ring).union(free)
    own = edges.select("crate", F.sha2("crate", 256).alias("digest"))
    got = [dict(fingerprint.merkle(own.withColumn("digest", F.when(F.col("crate") == changed, "x").otherwise(F.col("digest"))), edges, "s").collect()) for changed in ("", "a500")]
    assert len(got[0]) == 110_005 and {k for k in got[0] if got[0][k] != got[1][k]} == {f"a{k}" for k in range(501)}
    assert len({v for k, v in got[0].items() if k[0] == "b"}) == 1

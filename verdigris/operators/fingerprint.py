"""Content fingerprints of crates. Digests are SHA-256; only their equality has a meaning."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators import graph
from verdigris.storage import bucketed, remove, work_dir, written

ZERO = "0" * 64


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def own_digests(files: DataFrame, by: str = "crate") -> DataFrame:
    """crate, digest: of the files' (rel, digest), sorted by rel."""
    leaf = F.concat(F.col("rel"), F.lit("\0"), F.col("digest"))
    return files.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("digest"))


def domain(compiler: str, lock_digest: str | None, flags: str = "", globals_digest: str = "") -> str:
    """What all fingerprints depend on: compiler, lock file (zeros if missing), flags, and the workspace's global files."""
    return "\0".join((compiler, lock_digest or ZERO, flags, globals_digest))


def closure_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """crate, member: each node with itself and all it depends on; cycles are fine. Each round joins the pairs with
    themselves, so paths of length n take about log2(n) rounds, until no pair is new."""
    spark = edges.sparkSession
    home, k = work_dir(spark, "closure"), 0
    own = nodes.select(F.col(nodes.columns[0]).alias("crate"), F.col(nodes.columns[0]).alias("member"))
    e = edges.select("crate", F.col("dep").alias("member")).where("crate is not null and member is not null")
    pairs = written(own.union(e).distinct(), f"{home}/0")
    n = pairs.count()
    while True:
        k += 1
        both = pairs.join(pairs.select(F.col("crate").alias("member"), F.col("member").alias("further")), "member").select("crate", F.col("further").alias("member"))
        last, pairs = n, written(pairs.union(both).distinct(), f"{home}/{k}")
        remove(spark, f"{home}/{k - 1}")
        n = pairs.count()
        if n == last:
            return pairs.join(nodes.select(F.col(nodes.columns[0]).alias("crate")).distinct(), "crate", "left_semi")


def fingerprints(own: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """crate, fingerprint: of the scope and the sorted (name, own digest) of all that the crate depends on, itself
    included. A crate without a digest counts with zeros. Cycles have no effect on what is covered."""
    pairs = closure_pairs(edges, own.select("crate"))
    leaf = F.concat(F.col("member"), F.lit("="), F.coalesce("digest", F.lit(ZERO)))
    both = pairs.join(own.select(F.col("crate").alias("member"), "digest"), "member", "left")
    return both.groupBy("crate").agg(F.sha2(F.concat(F.lit(scope + "\0"), F.array_join(F.array_sort(F.collect_list(leaf)), "\n")), 256).alias("fingerprint"))


def merkle(own: DataFrame, edges: DataFrame, scope: str, size: int = graph.PART) -> DataFrame:
    """crate, fingerprint: of the scope, the own digest and the sorted (name, fingerprint) of the direct dependencies.
    Crates on a cycle have one fingerprint: of the scope, the digest over the cycle's members, and the dependencies of all
    of them outside it. Crates that depend on each other directly are put together first, by one join. What then lies on no
    cycle and depends on none is folded; of the rest, what no cycle depends on is peeled off from above; longer cycles are
    sought in what remains, and the graph of cycles and others, which has none, is folded."""
    spark = own.sparkSession
    home = work_dir(spark, "merkle")
    nodes = own.where("crate is not null").groupBy(F.col("crate").alias("node")).agg(F.min(F.coalesce("digest", F.lit(ZERO))).alias("digest"))
    nodes = written(nodes, f"{home}/own")
    known = nodes.select("node")
    e = edges.select(F.col("crate").alias("node"), F.col("dep").alias("name"), F.col("dep")).where("crate <> dep").distinct()
    e = written(e.join(known.select(F.col("node").alias("dep")), "dep", "left_semi").join(known, "node", "left_semi").select("node", "name", "dep"), f"{home}/edges")
    mutual = written(e.select("node", "dep").intersect(e.select("dep", "node")), f"{home}/mutual")
    at, heads, up = None, nodes, e
    if not mutual.isEmpty():
        pairs = graph.spread(mutual.select(F.col("node").alias("s"), F.col("dep").alias("d")), mutual.select("node", F.col("node").alias("label")), size)
        at = written(nodes.join(pairs, "node", "left").select("node", "digest", F.coalesce("label", "node").alias("of")), f"{home}/pairs")
        heads, up = (written(t, f"{home}/{name}") for t, name in zip(_contracted(at, e), ("heads", "up"), strict=True))
    done = folded(heads, up, scope, size=size)
    rest = written(heads.join(done, "node", "left_anti").select("node"), f"{home}/rest")
    if not rest.isEmpty():
        inner = up.join(rest, "node", "left_semi").join(rest.select(F.col("node").alias("dep")), "dep", "left_semi")
        inner = written(inner.select("node", "dep").distinct(), f"{home}/inner")
        above = folded(rest.withColumn("digest", F.lit("")), inner.select(F.col("dep").alias("node"), F.col("node").alias("name"), F.col("node").alias("dep")), scope, size=size).select("node")
        core = inner.join(above, "node", "left_anti").join(above.select(F.col("node").alias("dep")), "dep", "left_anti")
        cycle = written(graph.cycles(core.select(F.col("node").alias("s"), F.col("dep").alias("d")), size), f"{home}/cycles")
        of = (nodes.withColumn("of", F.col("node")) if at is None else at).join(cycle.select(F.col("node").alias("of"), "component"), "of", "left")
        at = written(of.select("node", "digest", F.coalesce("component", "of").alias("of")), f"{home}/of")
        heads, up = (written(t.join(done, "node", "left_anti"), f"{home}/{name}") for t, name in zip(_contracted(at, e), ("last-heads", "last-up"), strict=True))
        done = done.union(folded(heads, up, scope, done, size))
    if at is None:
        return done.select(F.col("node").alias("crate"), "fingerprint")
    return at.select("node", "of").join(done.select(F.col("node").alias("of"), "fingerprint"), "of").select(F.col("node").alias("crate"), "fingerprint")


def _contracted(at: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, digest) and edges (node, name, dep) of the graph in which the nodes of each group (`of` in at) are one:
    its digest is that over its members, its dependencies are those of all of them outside it, by their own names."""
    many = at.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of")
    whole = _sealed(at.join(many, "of", "left_semi").select("of", F.concat("node", F.lit("="), "digest").alias("leaf")))
    of = at.select("node", "of")
    up = edges.join(of, "node").select("of", "name", "dep").join(of.select(F.col("node").alias("dep"), F.col("of").alias("dep_of")), "dep")
    up = up.select(F.col("of").alias("node"), "name", F.col("dep_of").alias("dep")).where("node <> dep").distinct()
    return at.join(many, "of", "left_anti").select("node", "digest").union(whole), up


def _sealed(leaves: DataFrame) -> DataFrame:
    """node, digest: of each group's (of) leaves, by their digests: a tree of fixed shape, by the digests' first four and
    two letters, so that no group is collected whole."""
    t = leaves.select("of", F.sha2("leaf", 256).alias("h")).withColumn("key", F.substring("h", 1, 4))
    for width in (2, 0):
        t = t.groupBy("of", "key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h")).withColumn("key", F.expr(f"substring(key, 1, {width})"))
    return t.groupBy("of").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h")).select(F.col("of").alias("node"), F.col("h").alias("digest"))


def folded(nodes: DataFrame, edges: DataFrame, scope: str, given: DataFrame | None = None, size: int = graph.PART) -> DataFrame:
    """node, fingerprint of the nodes (node, digest) all of whose dependencies, by the edges (node, name, dep), have one:
    a node of this kind, or one of those given (node, fingerprint). Others, which lie on or above a cycle, are left out.

    A graph of `size` rows (nodes and edges) at most is folded in one task, at any depth. A larger one is folded from below,
    a round for each level: only what depends on the round before is joined, and what still waits for another dependency is
    kept with what has arrived. Once no more than `size` rows are left and a round folds less than an eighth of them, they
    are folded in one task, however deep they are.
    A node's own dependencies are in one task. Both inputs are read several times."""
    spark = nodes.sparkSession
    home, k = work_dir(spark, "folded"), 0
    left, none = nodes.count() + edges.count(), nodes.select("node", F.col("digest").alias("fingerprint")).limit(0)
    known = none if given is None else given.select("node", "fingerprint")
    if left <= size:
        return written(_in_one_task(nodes, edges, known, scope), f"{home}/last")
    order = Window.partitionBy("node").orderBy("name", "dep")
    needs = edges.join(nodes, "node").withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("node")), "first": F.row_number().over(order) == 1})
    needs = needs.select("dep", "node", "name", "n", F.when(F.col("first"), F.col("digest")).alias("digest"))
    needs, table = bucketed(needs, f"{home}/needs", "dep", max(1, -(-4 * left // size)))
    print_of = lambda digest, leaves: F.sha2(F.concat(F.lit(scope + "\0"), digest, F.lit("\0"), F.array_join(F.array_sort(leaves), "\n")), 256)
    leaf = nodes.join(edges.select("node"), "node", "left_anti").select("node", F.lit(0).cast("bigint").alias("n"), "digest", F.array().cast("array<string>").alias("leaves"))
    level, found, new, waiting = leaf.withColumn("fingerprint", print_of(F.col("digest"), F.col("leaves"))), [], known, None
    while True:
        found.append(f"{home}/{k}")
        level, k = written(level.select("node", "fingerprint", "n", F.expr("if(fingerprint is null, digest, null) as digest"), F.expr("if(fingerprint is null, leaves, null) as leaves")), found[-1]), k + 1
        ready = level.where("fingerprint is not null").select("node", "fingerprint", "n")
        folds = ready.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        left -= folds[0] + folds[1]
        deep = left <= size and 8 * (folds[0] + folds[1]) < left
        new = ready.select("node", "fingerprint") if k > 1 else new.union(ready.select("node", "fingerprint"))
        if not left or deep or (k > 1 and not folds[0]):
            break
        waiting = level.where("fingerprint is null").select("node", "n", "digest", "leaves")
        arrive = needs.join(new.withColumnRenamed("node", "dep"), "dep").select("node", "n", "digest", F.array(F.concat("name", F.lit("="), "fingerprint")).alias("leaves"))
        level = arrive.union(waiting).groupBy("node").agg(F.max("n").alias("n"), F.max("digest").alias("digest"), F.flatten(F.collect_list("leaves")).alias("leaves"))
        level = level.withColumn("fingerprint", F.when(F.size("leaves") == F.col("n"), print_of(F.col("digest"), F.col("leaves"))))
    spark.sql(f"drop table {table}")
    done = spark.read.schema(level.schema).parquet(*found).where("fingerprint is not null").select("node", "fingerprint")
    if not deep:
        return done
    rest = written(nodes.join(done, "node", "left_anti"), f"{home}/rest")
    inner = written(edges.join(rest, "node", "left_semi"), f"{home}/inner")
    return done.union(written(_in_one_task(rest, inner, known.union(done), scope), f"{home}/last"))


def _in_one_task(nodes: DataFrame, edges: DataFrame, known: DataFrame, scope: str) -> DataFrame:
    """node, fingerprint: as folded(), of a graph that one task holds, with those of the known that it depends on."""
    known = known.join(edges.select(F.col("dep").alias("node")), "node", "left_semi")
    rows = nodes.select("node", "digest", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("dep")).union(edges.select("node", F.lit(None).cast("string"), "name", "dep"))
    one = lambda df: df.withColumn("part", F.lit(0)).groupBy("part")
    return one(rows).cogroup(one(known.select(F.col("node").alias("node"), F.col("fingerprint").alias("fingerprint")))).applyInArrow(lambda a, b: _folded(a, b, scope), "node string, fingerprint string")


def _folded(rows: pa.Table, new: pa.Table, scope: str) -> pa.Table:
    node, digest, name, dep = (rows.column(c).to_pylist() for c in ("node", "digest", "name", "dep"))
    own, known = {}, dict(zip(new.column("node").to_pylist(), new.column("fingerprint").to_pylist(), strict=True))
    needs: dict[str, list[tuple[str, str]]] = {}
    users: dict[str, list[str]] = {}
    missing: dict[str, int] = {}
    for v, x, as_name, d in zip(node, digest, name, dep, strict=True):
        if d is None:
            own[v] = x
        else:
            needs.setdefault(v, []).append((as_name, d))
            if d not in known:
                users.setdefault(d, []).append(v)
                missing[v] = missing.get(v, 0) + 1
    ready, found = [v for v in own if v not in missing], {}
    while ready:
        v = ready.pop()
        deps = "\n".join(sorted(f"{n}={known[d]}" for n, d in needs.get(v, [])))
        found[v] = known[v] = hashlib.sha256("\0".join((scope, own[v], deps)).encode()).hexdigest()
        for u in users.pop(v, []):
            missing[u] -= 1
            if not missing[u]:
                ready.append(u)
    return pa.table({"node": pa.array(list(found), pa.string()), "fingerprint": pa.array(list(found.values()), pa.string())})

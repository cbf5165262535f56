"""Ownership of paths and test ids by longest prefix, and reachability over dependency edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.storage import bucketed, work_dir, written

#: Edges to a part of a graph, about; the part number that stands for all of them.
PART, EVERY = 1 << 20, -1


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, component by component."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))


def prefixes(test_id: Column) -> Column:
    """Every prefix of an id that ends at `::`, and the id itself, with hyphens as underscores."""
    parts = F.split(F.translate(test_id, "-", "_"), "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("::", F.slice(parts, 1, i)))


def owned_paths(files: DataFrame, members: DataFrame, path: str = "path") -> DataFrame:
    """files and owner: the member whose manifest_dir is the longest ancestor of the path; null if none is. Members with
    one folder: the first by pos (a column of members) or by name. Paths are joined with their ancestors by equality, so
    neither side needs to be small."""
    first = F.col("pos") if "pos" in members.columns else F.col("name")
    dirs = members.groupBy(F.rtrim("manifest_dir", F.lit("/")).alias("dir")).agg(F.min_by("name", first).alias("owner"))
    up = files.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("dir"))
    best = up.join(dirs, "dir").groupBy(path).agg(F.max_by("owner", F.length("dir")).alias("owner"))
    return files.join(best, path, "left")


def owned_tests(tests: DataFrame, crates: DataFrame, test_id: str = "id", pos: str | None = None) -> DataFrame:
    """tests and owner: the crate whose name, hyphens as underscores, is the longest `::`-prefix of the id. Crates that
    differ only in hyphens: the last by pos, or by name."""
    last = F.col(pos) if pos else F.col("crate")
    names = crates.groupBy(F.translate("crate", "-", "_").alias("prefix")).agg(F.max_by("crate", last).alias("owner"))
    up = tests.select(test_id).distinct().select(test_id, F.explode(prefixes(F.col(test_id))).alias("prefix"))
    best = up.join(names, "prefix").groupBy(test_id).agg(F.max_by("owner", F.length("prefix")).alias("owner"))
    return tests.join(best, test_id, "left")


def resolved(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges whose two ends are members, once each."""
    names = members.select("name").distinct()
    return edges.join(names, edges["dep"] == names["name"], "left_semi").join(names, edges["crate"] == names["name"], "left_semi").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, src: str, dst: str, size: int = PART) -> DataFrame:
    """node: the seeds, and what edges reach from them; cycles are fine."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"))
    return spread(e, seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("label")), size).select("node")


def spread(edges: DataFrame, seeds: DataFrame, size: int = PART) -> DataFrame:
    """node, label: the least label of the seeds (node, label) that reach the node along edges (s, d); cycles are fine.

    Edges are dealt once to parts of about `size`, by their source. In a round each part follows its edges from the nodes
    that arrive, as far as they lead inside the part; only nodes of other parts are exchanged, and of these only those
    that did not arrive before with as small a label. A graph that fits one part takes one round, a longer way through
    several parts as many as it changes parts. The edges of a node with more than a quarter of a part are dealt by their
    targets, and what arrives there goes to all parts."""
    spark = edges.sparkSession
    home = work_dir(spark, "spread")
    node_type, label_type = edges.schema["s"].dataType.simpleString(), seeds.schema["label"].dataType.simpleString()
    e = written(edges.select("s", F.col("d").cast(node_type).alias("d")).where("s is not null and d is not null"), f"{home}/edges")
    parts = max(1, -(-e.count() // size))
    part_of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    hubs = written(e.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size // 4).select(F.col("s").alias("hub")), f"{home}/hubs") if parts > 1 else None
    if hubs is None:
        e, to = e.withColumns({"part": F.lit(0), "to": F.lit(0)}), lambda nodes: nodes.withColumn("to", F.lit(0))
    else:
        to = lambda nodes, c="node": nodes.join(hubs, F.col(c) == F.col("hub"), "left").withColumn("to", F.when(F.col("hub").isNull(), part_of(c)).otherwise(EVERY)).drop("hub")
        e = to(e, "d").join(hubs, F.col("s") == F.col("hub"), "left").withColumn("part", F.when(F.col("hub").isNull(), part_of("s")).otherwise(part_of("d"))).drop("hub")
        e, table = bucketed(e, f"{home}/parts", "part", parts)
    arrive = lambda nodes: nodes.withColumn("part", F.explode(F.when(F.col("to") == EVERY, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("to")))).drop("to")
    new = to(seeds.select(F.col("node").cast(node_type).alias("node"), "label").where("node is not null").groupBy("node").agg(F.min("label").alias("label")))
    walk = lambda here, new: here.groupBy("part").cogroup(arrive(new).groupBy("part")).applyInArrow(_walked, f"node {node_type}, label {label_type}, to int")
    if parts == 1:
        return written(walk(e, new), f"{home}/found").select("node", "label")
    found, seen, new = [], None, written(new, f"{home}/new")
    while not new.isEmpty():
        at = [r[0] for r in arrive(new.select("to").distinct()).select("part").distinct().collect()]  # of the parts at most
        found.append(f"{home}/found{len(found)}")
        out = written(walk(e if len(at) == parts else e.where(F.col("part").isin(at)), new), found[-1])
        seen = new.select("node", "label") if seen is None else seen.union(new.select("node", "label"))
        before = seen.groupBy(F.col("node").alias("of")).agg(F.min("label").alias("least"))
        new = out.where("to is not null").groupBy("node", "to").agg(F.min("label").alias("label")).join(before, F.col("node") == F.col("of"), "left")
        new = written(new.where("least is null or label < least").select("node", "label", "to"), f"{home}/new{len(found)}")
    spark.sql(f"drop table {table}")
    if not found:
        return seeds.select(F.col("node").cast(node_type).alias("node"), "label").limit(0)
    return spark.read.schema(out.schema).parquet(*found).where("to is null").groupBy("node").agg(F.min("label").alias("label"))


def _walked(edges: pa.Table, new: pa.Table) -> pa.Table:
    """What the arrived nodes reach in the part, `to` null, and the nodes of other parts (and those dealt to all) that it
    leads to. Least labels go first, so that each node is visited once."""
    s, d, at = edges.column("s"), edges.column("d"), new.column("node")
    names = pa.chunked_array([*s.chunks, *d.chunks, *at.chunks], type=s.type).combine_chunks().dictionary_encode()
    codes, names = names.indices.to_numpy(zero_copy_only=False), names.dictionary
    s, d, at = codes[: len(s)], codes[len(s) : 2 * len(s)], codes[2 * len(s) :].tolist()
    order = np.argsort(s, kind="stable")
    first, next_of = np.searchsorted(s[order], np.arange(len(names) + 1)).tolist(), d[order].tolist()
    to = np.full(len(names), -2)
    if len(d):
        to[d] = edges.column("to").to_numpy()
        to[to == edges.column("part")[0].as_py()] = -2
    inside, label, labels, passed = (to == -2).tolist(), [None] * len(names), new.column("label").to_pylist(), []
    for k in sorted(range(len(at)), key=labels.__getitem__):
        own, stack = labels[k], [at[k]]
        if not inside[at[k]]:
            passed.append(k)
        elif label[at[k]] is None:
            label[at[k]] = own
        else:
            continue
        while stack:
            v = stack.pop()
            for u in next_of[first[v] : first[v + 1]]:
                if label[u] is None:
                    label[u] = own
                    if inside[u]:
                        stack.append(u)
    got = [k for k, x in enumerate(label) if x is not None]
    nodes, to = np.array(got + [at[k] for k in passed], np.int64), np.concatenate([to[got], np.full(len(passed), -2)])
    found = pa.array([label[k] for k in got] + [labels[k] for k in passed], new.schema.field("label").type)
    return pa.table({"node": names.take(pa.array(nodes)), "label": found, "to": pa.array(to, pa.int32(), mask=to == -2)})


def cycles(edges: DataFrame, size: int = PART) -> DataFrame:
    """node, component: the strongly connected component of each node of the edges (s, d), named by its least node. By
    colours: a round finds the least node that reaches each node and the least that it reaches, and takes out the edges
    whose ends differ in one of these. Ends of one component never do; where no edge is taken out, the least node of
    what hangs together reaches all of it and is reached by all, so it is one component."""
    spark = edges.sparkSession
    home, k = work_dir(spark, "cycles"), 0
    rest = written(edges.select("s", "d").where("s <> d").distinct(), f"{home}/0")
    nodes = written(edges.select(F.explode(F.array("s", "d")).alias("node")).where("node is not null").distinct(), f"{home}/nodes")
    n = rest.count()
    while n:
        ends = rest.select(F.explode(F.array("s", "d")).alias("node")).distinct().withColumn("label", F.col("node"))
        back = rest.select(F.col("d").alias("s"), F.col("s").alias("d"))
        colour = spread(rest, ends, size).withColumnRenamed("label", "above").join(spread(back, ends, size).withColumnRenamed("label", "below"), "node")
        colour = written(colour, f"{home}/colour{k}")
        of = lambda end, c=colour: c.select(F.col("node").alias(end), F.struct("above", "below").alias(f"colour_{end}"))
        same = rest.join(of("s"), "s").join(of("d"), "d").where("colour_s = colour_d").select("s", "d")
        k, last, rest = k + 1, n, written(same, f"{home}/{k + 1}")
        n = rest.count()
        if n == last:
            return nodes.join(colour, "node", "left").select("node", F.coalesce("above", "node").alias("component"))
    return nodes.select("node", F.col("node").alias("component"))


def affected(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """crate: the seeds and every crate that depends on one of them, directly or not. edges: (crate, dep)."""
    return reachable(edges, seeds, "dep", "crate").select(F.col("node").alias("crate"))


def names(members: DataFrame) -> DataFrame:
    return members.select("name").distinct().orderBy("name")

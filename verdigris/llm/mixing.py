"""Mixing sources to target weights by blocks.

Each source's words, in order, are packed into blocks of a fixed length; the last may be shorter. A source's slots run
through its blocks epoch by epoch, each epoch under its own pseudorandom permutation (the short block stays last), and
stop at the target, so that every source gives exactly its target rounded to a word. Slots are dealt to output shards by
multinomial draws over what each source has left: the driver draws for buckets of sources, and each bucket's task divides
its draws among its sources, which has the same distribution. Slots and documents then meet at the block's index.

Texts are read for their size and hash alone; everything but the pipeline's last join works on these. Sources are rows of
a table: the driver holds a few sums and the buckets' draws.

Defined cases: a null text has no words and is never taken; null sources form one source, ordered last; documents are
ordered by doc_id (null first), size and hash inside a source; repeated rows are taken one by one; an empty table or
one without words gives 0 taken everywhere; other columns do not matter and are kept by the stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.shared import numbered, work_dir, written
from verdigris.llm.text import mix

WEIGHTS, REPEATS, BLOCK, SHARDS, SEED = (5, 2, 1), 3, 256, 64, 20240601
ROWS_PER_GROUP, LEAST_GROUPS, SLOTS_PER_TASK, SOURCES_PER_BUCKET = 50_000, 256, 200_000, 4096


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Shares of all sizes by repeating weights; what is above repeats times a source's size goes to the others. What
    shared() does for a table of sources, for a list."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i % len(weights)] for i in free)
        for i in free:
            out[i] = left * weights[i % len(weights)] / w
        over = {i for i in free if out[i] > repeats * sizes[i]}
        if not over:
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in over]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the next even number of bits, repeated while outside."""
    if n < 2:
        return index
    half = (int(n - 1).bit_length() + 1) // 2
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            a, b = b, a ^ (mix(b + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _identity(text: str = "text", source: str = "source") -> dict[str, Column]:
    own = F.col(f"`{source}`").cast("string")
    return {"doc_id": F.col("doc_id").cast("bigint"), "h": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "name": F.coalesce(own, F.lit("")), "unnamed": own.isNull()}


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """A row a document without its text: doc_id, h (of the text), name and unnamed (its source), size in words."""
    n = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[^ \\x09-\\x0D]+")).cast("bigint")
    return docs.select(*(c.alias(k) for k, c in _identity(text, source).items()), n.alias("size"))


def shared(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sources (i, size, ...) with target: one aggregate a round raises what a unit of weight gets, until no further
    source is above repeats times its size."""
    w, most = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")), F.col("size") * repeats
    unit, full = None, -1
    while True:
        above = F.lit(False) if unit is None else w * unit > most
        r = sources.agg(F.sum("size").alias("all"), F.sum(F.when(above, most)).alias("fixed"), F.sum(F.when(~above, w)).alias("free"), F.count_if(above).alias("full")).first()
        if r["full"] == full or not r["free"]:
            break
        unit, full = ((r["all"] or 0) - (r["fixed"] or 0)) / r["free"], r["full"]
    return sources.withColumn("target", F.least(w * float(unit or 0.0), most.cast("double")))


def drawn(left: np.ndarray, need: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many slots each row gives to each shard: multinomial draws in proportion to what is left, drawn again where
    a row has no more. need: by shard; together not above what is left."""
    out, left = np.zeros((len(need), len(left)), np.int64), left.copy()
    for k, n in enumerate(need.tolist()):
        while n:
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            out[k] += got
            left -= got
            n -= int(got.sum())
    return out


def slots(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """i, slot, shard, block, words: how many words of the block's beginning this slot takes. sources: i, size, goal."""
    spark, size, goal = sources.sparkSession, F.col("size"), F.col("goal")
    full = F.floor(size / block)
    blocks = full + (size > full * block).cast("bigint")
    whole = F.floor(goal / size)
    s = sources.where("size > 0 and goal > 0").withColumns({"nf": full, "nb": blocks, "slots": whole * blocks + F.ceil((goal - whole * size) / block)})
    n = sources.count()
    buckets = max(1, -(-n // SOURCES_PER_BUCKET))
    s = s.withColumn("bucket", (F.col("i") % buckets).cast("int"))
    sums = {r["bucket"]: r["n"] for r in s.groupBy("bucket").agg(F.sum("slots").alias("n")).collect()}
    held = np.array([sums.get(b, 0) for b in range(buckets)], np.int64)
    total = int(held.sum())
    per = -(-total // shards)
    need = drawn(held, np.array([max(0, min(per, total - k * per)) for k in range(shards)], np.int64), np.random.default_rng(seed))

    def divide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        bucket = rows.column("bucket")[0].as_py()
        ends = drawn(rows.column("slots").to_numpy().astype(np.int64), need[:, bucket], np.random.default_rng([seed, bucket])).cumsum(axis=0)
        return rows.select(["i", "size", "goal", "nf", "nb", "slots"]).append_column("ends", pa.array(list(ends.T), pa.list_(pa.int64())))

    kept = "i long, size long, goal long, nf long, nb long, slots long"
    s = s.select("bucket", *(F.col(c).cast("bigint").alias(c) for c in ("i", "size", "goal", "nf", "nb", "slots"))).groupBy("bucket").applyInArrow(divide, f"{kept}, ends array<long>")
    s = s.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1, F.lit(SLOTS_PER_TASK).cast("bigint"))))

    def fill(batches):
        for b in batches:
            for x in b.to_pylist():
                nf, nb = x["nf"], x["nb"]
                i = np.arange(x["lo"], min(x["lo"] + SLOTS_PER_TASK, x["slots"]))
                epoch, j = i // nb, i % nb
                at = j.copy()
                for e in np.unique(epoch):
                    inside = np.flatnonzero((epoch == e) & (j < nf))
                    at[inside] = permuted(j[inside], nf, seed + x["i"] * 1_000_003 + int(e))
                words = np.minimum(np.where(j < nf, block, x["size"] - nf * block), x["goal"] - (epoch * x["size"] + j * block))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), x["i"], np.int64)), pa.array(i), pa.array(np.searchsorted(np.array(x["ends"]), i, "right").astype(np.int32)), pa.array(at), pa.array(words.astype(np.int32))], names=["i", "slot", "shard", "block", "words"])

    tasks = total // SLOTS_PER_TASK + min(n, spark.sparkContext.defaultParallelism)
    return s.repartition(max(1, min(tasks, spark.sparkContext.defaultParallelism * 8))).mapInArrow(fill, "i long, slot long, shard int, block long, words int")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row a document: doc_id, h, name, unnamed (see sized), size, source_size, target (its source's), taken."""
    spark = docs.sparkSession
    d = written(sized(docs, text, source), work_dir(spark, "sized"))
    known = numbered(d.groupBy("unnamed", "name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), ["unnamed", "name"], "i")
    known = written(shared(known, weights, repeats).withColumn("goal", F.least(F.floor(F.col("target") + 0.5), F.col("size") * repeats)), work_dir(spark, "sources"))
    groups = max(LEAST_GROUPS, -(-(known.agg(F.sum("n")).first()[0] or 0) // ROWS_PER_GROUP))
    d = d.withColumn("g", F.pmod(F.xxhash64("doc_id", "h"), F.lit(groups)).cast("int"))
    before: Column = F.coalesce(F.sum("size").over(Window.partitionBy("unnamed", "name").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = d.groupBy("unnamed", "name", "g").agg(F.sum("size").alias("size")).select("unnamed", "name", "g", before.alias("base"))
    offset = offset.join(known.select("unnamed", "name", "i", F.col("size").alias("source_size"), "target"), ["unnamed", "name"])
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("unnamed", "name", "g").orderBy("doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("inner", inner).join(offset.hint("merge"), ["unnamed", "name", "g"])
    d = written(d.select("doc_id", "h", "name", "unnamed", "size", "source_size", "target", "i", (F.col("base") + F.col("inner")).alias("start")), work_dir(spark, "placed"))
    uses = slots(known.select("i", "size", "goal"), block, shards, seed).groupBy("i", "block", "words").agg(F.count(F.lit(1)).alias("n"))
    end = F.col("start") + F.col("size")
    spread = d.where("size > 0").select("i", "start", end.alias("end"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    share = F.greatest(F.lit(0), F.least(F.col("end"), F.col("block") * block + F.col("words")) - F.greatest("start", F.col("block") * block))
    taken = spread.join(uses.hint("merge"), ["i", "block"]).groupBy("i", "start").agg(F.sum(F.col("n") * share).alias("taken"))
    out = d.join(taken.select(F.col("i").alias("i2"), F.col("start").alias("start2"), "taken").hint("merge"), (F.col("i") == F.col("i2")) & (F.col("start") == F.col("start2")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "h", "name", "unnamed", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, as often as the mix takes it in full, rounded; a document of which it takes less than
    half goes. Without words nothing can be taken, so such documents go too. Rows that agree in doc_id, source and text
    share what they are taken together."""
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)
    m = mixed(docs).groupBy(F.col("doc_id").alias("of"), "h", "name", "unnamed").agg(F.sum(times).cast("int").alias("times"), F.count(F.lit(1)).cast("int").alias("rows"))
    m = written(m.where("times > 0"), work_dir(spark, "times"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(f"{n}2") for n, c in _identity().items()))
    joined = own.join(m.hint("merge"), own["doc_id2"].eqNullSafe(m["of"]) & (own["h2"] == m["h"]) & (own["name2"] == m["name"]) & (own["unnamed2"] == m["unnamed"]))
    out = lambda d, n: d.select("row", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select("row.*")
    once = out(joined.where("rows = 1"), F.col("times"))
    if m.where("rows > 1").isEmpty():
        return once
    k = F.row_number().over(Window.partitionBy("of", "h", "name", "unnamed").orderBy(F.xxhash64("row")))
    again = joined.where("rows > 1").withColumn("k", k)
    return once.unionByName(out(again, F.floor(F.col("times") / F.col("rows")) + (F.col("k") <= F.col("times") % F.col("rows")).cast("int")))

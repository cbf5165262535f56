"""Ranges of lines, first to last, both inside; no line of them is ever listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.storage import work_dir, written


def as_ranges(df: DataFrame) -> DataFrame:
    """df with first and last: its own, or its line as both."""
    return df if "first" in df.columns else df.withColumns({"first": F.col("line"), "last": F.col("line")}).drop("line")


def united(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last: the ranges of each key as few as possible; those that overlap or touch become one. A range begins
    a new one where a gap is before it, and what is between two gaps is one."""
    r = ranges.select(*keys, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")).where("first <= last").distinct()
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("__gap", F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int"))
    r = r.withColumn("__part", F.sum("__gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "__part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__part")


def pieces(first: str = "first", last: str = "last") -> Column:
    """(level, block) of the fewest blocks of 2**level lines, each beginning at a multiple of its size, that make up a range:
    two a level at most."""
    a, e = f"cast({first} as bigint)", f"(cast({last} as bigint) + 1)"
    low, high = f"shiftright({a} + shiftleft(1L, k) - 1, k)", f"shiftright({e}, k)"
    one = lambda block: f"named_struct('level', k, 'block', {block})"
    level = f"array_compact(array(if({low} % 2 = 1, {one(low)}, null), if({high} % 2 = 1, {one(f'{high} - 1')}, null)))"
    return F.expr(f"flatten(transform(sequence(0, cast(floor(log2(greatest({e} - {a}, 1))) as int)), k -> if({low} < {high}, {level}, array())))")


#: Rows of one side of a join that are sent to every executor, at most.
SENT = 1 << 18


def dealt(ranges: DataFrame) -> DataFrame:
    """ranges with (__level, __block) of each of their pieces(), a row each."""
    a, e = "cast(first as bigint)", "(cast(last as bigint) + 1)"
    r = ranges.withColumn("__level", F.expr(f"explode(sequence(0, cast(floor(log2(greatest({e} - {a}, 1))) as int)))"))
    r = r.withColumns({"__low": F.expr(f"shiftright({a} + shiftleft(1L, __level) - 1, __level)"), "__high": F.expr(f"shiftright({e}, __level)")}).where("__low < __high")
    r = r.withColumn("__block", F.expr("explode(array(if(__low % 2 = 1, __low, null), if(__high % 2 = 1, __high - 1, null)))"))
    return r.where("__block is not null").drop("__low", "__high")


def stabbed(points: DataFrame, ranges: DataFrame, on: list[str], line: str = "line") -> DataFrame:
    """points with each range (of the same `on`) that their line is in, once. A range of n lines is dealt to its pieces, at
    most 2 * log2(n) + 2, and a point to the block it is in at each level up to the longest range's, so they meet by
    equality, on one block exactly, however long the range. Lines are not negative. Spark's estimates know nothing of the
    rows that dealing makes, so they are counted: a side of few is sent to all, and of two larger ones neither is."""
    span = ranges.agg(F.max(F.col("last").cast("bigint") - F.col("first")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    top = max(int(span["n"] or 0) + 1, 1).bit_length() - 1
    p = points.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("__block", F.expr(f"shiftright(cast({line} as bigint), __level)"))
    r = dealt(ranges)
    if span["rows"] * 2 * (top + 1) <= SENT:
        r = F.broadcast(r)
    else:
        p = F.broadcast(p) if points.count() * (top + 1) <= SENT else p.hint("merge")
    return p.join(r, [*on, "__level", "__block"]).drop("__level", "__block")


#: Lines of a file that one window orders: 2**CHUNK.
CHUNK = 16


def overlapping(left: DataFrame, right: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """keep (columns of left), once, of the ranges in left that share a line with one in right. Of the ranges in right that
    begin at a line or before it, how far does one reach? A range overlaps one in right exactly if what begins up to its
    last line reaches its first. This is asked once for each different last line, in chunks of lines: by what is before
    the chunk, whose furthest is carried over the chunks of a file, and in the chunk. No range is dealt to several rows, so
    what is shuffled grows with the ranges, however long they are. Of few files in right, left is cut to these first."""
    home = work_dir(left.sparkSession, "overlapping")
    whole = lambda df, *more: df.select(*on, *more, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")).where("first <= last")
    a, b = whole(left, *keep), written(whole(right).groupBy(*on, "first").agg(F.max("last").alias("last")), f"{home}/right")
    files = b.select(*on).distinct()
    if files.limit(SENT + 1).count() <= SENT:
        a = a.join(F.broadcast(files), on, "left_semi")
    asked = a.select(*on, F.col("last").alias("at"), F.lit(None).cast("bigint").alias("reach")).distinct()
    steps = b.select(*on, F.col("first").alias("at"), F.col("last").alias("reach"))
    steps = written(asked.union(steps).groupBy(*on, "at").agg(F.max("reach").alias("reach"), F.max(F.col("reach").isNull()).alias("asked")).withColumn("chunk", F.shiftright("at", CHUNK)), f"{home}/steps")
    earlier = Window.partitionBy(*on).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.groupBy(*on, "chunk").agg(F.max("reach").alias("most")).select(*on, "chunk", F.max("most").over(earlier).alias("before"))
    upto = Window.partitionBy(*on, "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = steps.select(*on, "chunk", "at", "asked", F.max("reach").over(upto).alias("here")).where("asked").join(carried, [*on, "chunk"])
    reach = reach.select(*on, F.col("at").alias("last"), F.greatest("here", "before").alias("reach")).where("reach is not null")
    return a.join(reach, [*on, "last"]).where("reach >= first").select(*keep).distinct()

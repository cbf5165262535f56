"""References between source items: who names whom, and which item encloses a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import graph, ranges
from verdigris.operators.fingerprint import closure_pairs

FN, CONST, STATIC, TYPE, OPAQUE = "fn", "const", "static", "type_alias", "opaque"


def reference_edges(items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """src_item, dst_item: src names dst, directly or through a chain of use-aliases. An alias holds in every file; one
    that several files give different targets has them all. An item does not refer to itself."""
    named = items.where("name is not null and name <> ''").select(F.col("item_id").alias("dst_item"), "name")
    refs = items.select(F.col("item_id").alias("src_item"), F.explode(F.array_distinct("refs")).alias("name"))
    if aliases is not None:
        step = aliases.select("alias", "original").where("alias <> original").distinct()
        closed = closed_aliases(step)
        refs = refs.union(refs.join(closed, refs["name"] == closed["alias"]).select("src_item", F.col("original").alias("name"))).distinct()
    return refs.join(named, "name").where("src_item <> dst_item").select("src_item", "dst_item").distinct()


def closed_aliases(step: DataFrame) -> DataFrame:
    """alias, original: what each alias stands for in one or more steps."""
    pairs = closure_pairs(step.select(F.col("alias").alias("crate"), F.col("original").alias("dep")), step.select("alias").distinct())
    return pairs.where("crate <> member").select(F.col("crate").alias("alias"), F.col("member").alias("original"))


def users(items: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The functions among items that refer to a seed (item_id), directly or through any items; seeds included."""
    hit = graph.reachable(edges, seeds, "dst_item", "src_item")
    return items.where(F.col("kind") == FN).join(hit.select(F.col("node").alias("item_id")), "item_id", "left_semi")


def enclosing(lines: DataFrame, items: DataFrame, of_functions: bool) -> DataFrame:
    """lines (file, line) and item_id of the smallest enclosing item that is, or is not, a function; null if none is. Of
    equally small ones the first of the file, by pos (or by item_id, where items have no pos). Lines and items meet on
    blocks of two's powers, of which an item has few however long it is."""
    kind = F.col("kind") == FN if of_functions else F.col("kind") != FN
    place = F.col("pos" if "pos" in items.columns else "item_id").alias("place")
    spans = items.where(kind).where("start <= `end`").select("item_id", place, "file", F.col("start").alias("first"), F.col("end").alias("last"), (F.col("end") - F.col("start")).alias("width"))
    inside = ranges.stabbed(lines.select("file", "line").distinct(), spans, ["file"])
    best = inside.groupBy("file", "line").agg(F.min(F.struct("width", "place", "item_id")).alias("m"))
    return lines.join(best.select("file", "line", F.col("m.item_id").alias("item_id")), ["file", "line"], "left")

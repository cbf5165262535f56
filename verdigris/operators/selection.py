"""Which crates a set of changed files can affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import graph

# Files of the repository's root that concern every crate.
GLOBAL_FILES = ("Cargo.toml", "Cargo.lock", "rust-toolchain", "rust-toolchain.toml", ".cargo/config", ".cargo/config.toml")
CHANGED, AFFECTED, SKIPPED = "changed", "affected", "skipped"


def is_global(path: Column) -> Column:
    """Of a path relative to the repository's root."""
    return path.isin(*GLOBAL_FILES)


class Plan:
    """crates (crate, status) and summary (one row: select_all, changed, affected, skipped, ignored_files, reason)."""

    def __init__(self, crates: DataFrame, summary: DataFrame):
        self.crates, self.summary = crates, summary

    def is_empty(self) -> bool:
        return self.selected().isEmpty()

    def selected(self) -> DataFrame:
        """Crates to test: those that changed and those affected."""
        return self.crates.where(F.col("status") != SKIPPED).select("crate")

    def as_json(self) -> DataFrame:
        lists = self.crates.agg(*(F.array_sort(F.collect_list(F.when(F.col("status").isin(*of), F.col("crate")))).alias(name) for name, of in (("changed_crates", (CHANGED,)), ("affected", (CHANGED, AFFECTED)), ("skipped", (SKIPPED,)))))
        both = lists.join(F.broadcast(self.summary.select("select_all", "reason", "ignored_files")))
        return both.select(F.to_json(F.struct(*both.columns)).alias("json"))

    def as_lines(self) -> DataFrame:
        """status, crate, line: the reason (without either) and a line a crate; the text is their order by status and crate."""
        sign = F.when(F.col("status") == SKIPPED, "-").otherwise("+")
        crates = self.crates.select("status", "crate", F.concat(F.lit("  "), sign, F.lit(" "), "crate", F.lit(" ("), "status", F.lit(")")).alias("line"))
        return self.summary.select(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("crate"), F.col("reason").alias("line")).union(crates)

    def as_text(self) -> str:
        """The lines of a plan for a terminal."""
        return "\n".join(r["line"] for r in self.as_lines().orderBy(F.col("status").asc_nulls_first(), "crate").toLocalIterator())


def plan(members: DataFrame, edges: DataFrame, changed: DataFrame, root: str = "") -> Plan:
    """members (name, manifest_dir), edges (crate, dep), changed (path, relative to root). A global file selects every
    crate; it is neither owned nor ignored. Files that no member owns are ignored, and counted."""
    files = changed.select("path").where("trim(path) <> ''").distinct().withColumn("global", is_global(F.col("path")))
    full = F.concat_ws("/", F.lit(root.rstrip("/")), "path") if root else F.col("path")
    owned = graph.owned_paths(files.withColumn("full", full), members, "full")
    facts = owned.agg(F.coalesce(F.bool_or("global"), F.lit(False)).alias("select_all"), F.count_if(~F.col("global") & F.col("owner").isNull()).alias("ignored_files")).first()
    everyone = members.select(F.col("name").alias("crate")).distinct()
    seeds = owned.where("not global and owner is not null").select(F.col("owner").alias("crate")).distinct()
    if facts["select_all"]:
        seeds, reached = seeds.limit(0), everyone
    else:
        reached = graph.affected(graph.resolved(edges, members), seeds)
    status = F.when(F.col("c"), CHANGED).when(F.col("r"), AFFECTED).otherwise(SKIPPED)
    crates = everyone.join(seeds.withColumn("c", F.lit(True)), "crate", "left").join(reached.distinct().withColumn("r", F.lit(True)), "crate", "left").select("crate", status.alias("status"))
    n = [F.count_if(F.col("status") == s).alias(s) for s in (CHANGED, AFFECTED, SKIPPED)]
    summary = crates.agg(*n).withColumns({"select_all": F.lit(facts["select_all"]), "ignored_files": F.lit(facts["ignored_files"]).cast("bigint")})
    picked = F.col("changed") + F.col("affected")
    reason = F.when(F.col("select_all"), "a file of the whole workspace changed: every crate is selected").otherwise(F.format_string("%d changed, %d affected of %d crates; %d files ignored", F.col("changed"), picked, picked + F.col("skipped"), F.col("ignored_files")))
    return Plan(crates, summary.withColumn("reason", reason))


def candidates(plan: Plan, members: DataFrame, every: bool = False) -> DataFrame:
    return members.select(F.col("name").alias("crate")).distinct() if every else plan.selected()

"""Outcomes by crate, and which crates a green cache lets a run skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import graph


def crate_results(crates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """crate, passed: null where no outcome belongs to the crate, else whether all its outcomes passed. Exactly the
    given crates."""
    owned = graph.owned_tests(outcomes.select("id", "passed"), crates)
    per = owned.where("owner is not null").groupBy(F.col("owner").alias("crate")).agg(F.bool_and("passed").alias("passed"))
    return crates.select("crate").distinct().join(per, "crate", "left")


def aggregate_results(crates: DataFrame, ok: bool, exhaustive: bool) -> DataFrame:
    """crate, passed where a run gives one status for all: a failure counts for each crate; a pass only if nothing was
    filtered out."""
    return crates.select("crate").distinct().withColumn("passed", F.lit((True if exhaustive else None) if ok else False).cast("boolean"))


# Arguments that keep a run from covering all tests.
PARTIAL = ("--skip", "--exact", "--ignored", "--include-ignored")


def is_exhaustive(args: list[str]) -> bool:
    """Whether arguments to the test runner leave all tests in: no filter flag, and no positional word."""
    return not any(a in PARTIAL or (a and not a.startswith("-")) for a in args)


def exhaustive(args: Column) -> Column:
    """is_exhaustive() of an array of arguments."""
    return ~F.exists(args, lambda a: F.coalesce(a.isin(*PARTIAL) | ((a != "") & ~a.startswith("-")), F.lit(False)))


def with_green(crates: DataFrame, fingerprints: DataFrame, greens: DataFrame) -> DataFrame:
    """crate, fingerprint, green: the stored green has the crate's present fingerprint. Without one it is not green."""
    hit = greens.select("crate", "fingerprint").distinct().withColumn("green", F.lit(True))
    return crates.select("crate").join(fingerprints, "crate", "left").join(hit, ["crate", "fingerprint"], "left").select("crate", "fingerprint", F.coalesce("green", F.lit(False)).alias("green"))


def to_run(candidates: DataFrame, fingerprints: DataFrame, greens: DataFrame, no_cache: bool = False) -> DataFrame:
    """crate, run: whether it has to run. An empty set of candidates needs no fingerprints."""
    if no_cache:
        return candidates.select("crate", F.lit(True).alias("run"))
    return with_green(candidates, fingerprints, greens).select("crate", (~F.col("green")).alias("run"))

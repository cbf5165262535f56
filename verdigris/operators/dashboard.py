"""The dashboard's numbers: one row a crate, and a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import attribution, flaky, graph
from verdigris.operators.selection import SKIPPED


def crate_stats(history: DataFrame, crates: DataFrame) -> DataFrame:
    """crate, tests, total_ms: of the tests that a crate owns."""
    owned = graph.owned_tests(history.select("id", "last_duration_ms"), crates)
    return owned.where("owner is not null").groupBy(F.col("owner").alias("crate")).agg(F.count(F.lit(1)).alias("tests"), F.sum(F.coalesce("last_duration_ms", F.lit(0))).cast("bigint").alias("total_ms"))


def crates(status: DataFrame, fingerprints: DataFrame, greens: DataFrame, history: DataFrame) -> DataFrame:
    """crate, status, short_fp, cached_green, tests, total_ms. status: (crate, status) of a plan."""
    green = attribution.with_green(status, fingerprints, greens)
    out = status.join(green, "crate", "left").join(crate_stats(history, status.select("crate")), "crate", "left")
    return out.select("crate", "status", F.substring(F.coalesce("fingerprint", F.lit("")), 1, 12).alias("short_fp"), F.col("green").alias("cached_green"), F.coalesce("tests", F.lit(0)).cast("bigint").alias("tests"), F.coalesce("total_ms", F.lit(0)).cast("bigint").alias("total_ms"))


def header(rows: DataFrame, history: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: crate_count, affected_count, cached_count, hit_ratio, flaky_count, always_fail_count."""
    live = F.col("status") != SKIPPED
    top = rows.agg(F.count(F.lit(1)).alias("crate_count"), F.count_if(live).alias("affected_count"), F.count_if(live & F.col("cached_green")).alias("cached_count"))
    top = top.withColumn("hit_ratio", hit_ratio(F.col("cached_count"), F.col("affected_count")))
    scores = flaky.summary(flaky.score(history.select("id", "passes", "fails"), level))
    return top.join(F.broadcast(scores.select("flaky_count", "always_fail_count")))  # one row each


def hit_ratio(cached: Column, affected: Column) -> Column:
    """1 where nothing is affected."""
    return F.when(affected == 0, F.lit(1.0)).otherwise(cached / F.when(affected != 0, affected))


def bar(share: Column, cells: int = 10) -> Column:
    """A bar of that many cells, full up to the share, which is held to [0, 1]."""
    n = F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(cells) - n))

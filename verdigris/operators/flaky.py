"""Flakiness scores of tests from counts of passed and failed runs, and the report over them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import bayes, stats


def counts(outcomes: DataFrame, key: str, failed: str) -> DataFrame:
    """Runs (id, passes, fails) from one row a run; failed is a SQL condition. Sums are combined before the shuffle."""
    bad = F.coalesce(F.expr(failed), F.lit(False))
    return outcomes.groupBy(F.col(key).cast("string").alias("id")).agg(F.count_if(~bad).alias("passes"), F.count_if(bad).alias("fails"))


def score(runs: DataFrame, level: float = 0.95, posterior: bool = False) -> DataFrame:
    """For each row of runs: runs, passes, fails, flake_rate, ci (struct), verdict, reruns_to_reproduce_95, proven_below,
    and with posterior also post_mean, post_low, post_high. Duplicate ids stay separate."""
    n = stats.total(F.col("passes"), F.col("fails"))
    ci = stats.wilson(F.col("fails"), n, level)
    out = runs.withColumn("runs", n).withColumn("ci", ci).withColumn("verdict", stats.verdict(F.col("passes"), F.col("fails")))
    again = F.when(F.col("verdict") == "flaky", stats.required_reruns(F.col("ci.estimate"), stats.REPRODUCE))
    out = out.withColumns({"flake_rate": F.col("ci.estimate"), "reruns_to_reproduce_95": again, "proven_below": F.col("ci.high")})
    return bayes.jeffreys(out, level) if posterior else out


def flat(scores: DataFrame) -> DataFrame:
    """Scores with ci as ci_low and ci_high."""
    return scores.withColumns({"ci_low": F.col("ci.low"), "ci_high": F.col("ci.high")}).drop("ci")


def summary(scores: DataFrame) -> DataFrame:
    """One row: tests, flaky_count, always_fail_count."""
    return scores.agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("verdict") == "flaky").alias("flaky_count"), F.count_if(F.col("verdict") == "stable_fail").alias("always_fail_count"))


def shown(scores: DataFrame, position: str) -> DataFrame:
    """The rows a text report shows, in its order: flaky ones, then those that always fail, by position in the input."""
    order = F.when(F.col("verdict") == "flaky", 0).when(F.col("verdict") == "stable_fail", 1)
    return scores.withColumn("section", order).where("section is not null").orderBy("section", position)


def as_json(scores: DataFrame) -> DataFrame:
    return scores.select(F.to_json(F.struct(*scores.columns), {"ignoreNullFields": "false"}).alias("json"))


def lines(scores: DataFrame, position: str) -> Iterator[str]:
    """The report for people, line by line, in order; the driver holds one partition of it at a time."""
    head = {0: "FLAKY", 1: "ALWAYS FAILS"}
    for r in flat(shown(scores, position)).toLocalIterator():
        again = f", {r['reruns_to_reproduce_95']} reruns show it" if r["reruns_to_reproduce_95"] else ""
        yield f"{head[r['section']]:<13}{r['id']}  rate {r['flake_rate']:.4f} [{r['ci_low']:.4f}, {r['ci_high']:.4f}] of {r['runs']} runs{again}"


def as_text(scores: DataFrame, position: str) -> str:
    return "\n".join(lines(scores, position)) or "no flaky or failing test"

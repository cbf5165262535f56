"""Test histories: folding observed outcomes into counters, last failure, last known duration and recent outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = 50


#: A history whose last values and recent outcomes keep their order (run, ord), so that parts of it can be merged in any.
PARTIAL = "id string, passes bigint, fails bigint, fail struct<run:bigint,ord:bigint,at:bigint>, last struct<run:bigint,ord:bigint,ms:bigint>, recent array<struct<run:bigint,ord:bigint,passed:boolean>>"


def partial(observed: DataFrame, run: int = 0) -> DataFrame:
    """The PARTIAL history of outcomes (id, ord, at, passed, duration_ms): ord orders the outcomes of one id in a run.
    Counters and last values are combined before the shuffle; only the newest RECENT outcomes of an id take part in the
    ring."""
    o = observed.withColumn("run", F.lit(run).cast("bigint")).withColumn("ord", F.col("ord").cast("bigint"))
    agg = o.groupBy("id").agg(
        F.count_if("passed").alias("passes"),
        F.count_if(~F.col("passed")).alias("fails"),
        F.max(F.when(~F.col("passed"), F.struct("run", "ord", F.col("at").cast("bigint").alias("at")))).alias("fail"),
        F.max(F.when(F.col("duration_ms").isNotNull(), F.struct("run", "ord", F.col("duration_ms").cast("bigint").alias("ms")))).alias("last"),
    )
    top = o.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord").desc()))).where(F.col("rn") <= RECENT)
    ring = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "ord", "passed"))).alias("recent"))
    return agg.join(ring, "id", "left").select("id", "passes", "fails", "fail", "last", F.coalesce("recent", F.array().cast("array<struct<run:bigint,ord:bigint,passed:boolean>>")).alias("recent"))


def together(parts: DataFrame, keep: int = RECENT) -> DataFrame:
    """One PARTIAL history of several, in any order: an id has a row in each part at most."""
    ring = F.array_sort(F.flatten(F.collect_list("recent")))
    return parts.groupBy("id").agg(F.sum("passes").alias("passes"), F.sum("fails").alias("fails"), F.max("fail").alias("fail"), F.max("last").alias("last"), newest(ring, keep).alias("recent"))


def finished(parts: DataFrame) -> DataFrame:
    """A PARTIAL history without the orders."""
    return parts.select("id", "passes", "fails", F.col("fail.at").alias("last_fail"), F.col("last.ms").alias("last_duration_ms"), F.transform("recent", lambda x: x["passed"]).alias("recent"))


def as_partial(history: DataFrame) -> DataFrame:
    """A history as older than all runs, its outcomes in order."""
    order = [F.lit(-(2**62)).alias("run"), F.lit(0).cast("bigint").alias("ord")]
    at = lambda c, name: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).cast("bigint").alias(name)))
    return history.select("id", "passes", "fails", at("last_fail", "at").alias("fail"), at("last_duration_ms", "ms").alias("last"), F.transform("recent", lambda x, k: F.struct(order[0], k.cast("bigint").alias("ord"), x.alias("passed"))).alias("recent"))


def fold(observed: DataFrame) -> DataFrame:
    """History from outcomes (id, ord, at, passed, duration_ms)."""
    return finished(partial(observed))


def recent(observed: DataFrame, keep: int = RECENT) -> DataFrame:
    """id, recent: the newest `keep` outcomes, newest last. The rank limit is applied before and after the shuffle."""
    newest = observed.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord").desc()))).where(F.col("rn") <= keep)
    ring = F.array_sort(F.collect_list(F.struct("ord", "passed")))
    return newest.groupBy("id").agg(F.transform(ring, lambda x: x["passed"]).alias("recent"))


def merged(old: DataFrame, new: DataFrame, keep: int = RECENT) -> DataFrame:
    """One history from an older and a newer one: counters add up, newer last values win, rings are joined."""
    a, b = old.alias("a"), new.alias("b")
    ring = F.concat(F.coalesce("a.recent", F.array().cast("array<boolean>")), F.coalesce("b.recent", F.array().cast("array<boolean>")))
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    return both.select(
        F.coalesce("a.id", "b.id").alias("id"),
        *((F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in ("passes", "fails")),
        *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("last_fail", "last_duration_ms")),
        newest(ring, keep).alias("recent"),
    )


def newest(ring: Column, keep: int = RECENT) -> Column:
    """The last `keep` elements; all of a shorter array."""
    return F.slice(ring, F.greatest(F.lit(1), F.size(ring) - (keep - 1)), keep)


def recently_failed(ring: Column) -> Column:
    return F.exists(ring, lambda x: ~x)


def as_runs(history: DataFrame) -> DataFrame:
    return history.select("id", "passes", "fails")


def historically_flaky(history: DataFrame) -> DataFrame:
    """Ids that have both passed and failed."""
    return history.where("passes > 0 and fails > 0").select("id")


def green_changes(results: DataFrame, fingerprints: DataFrame, at: int) -> DataFrame:
    """What results (crate, passed) change in greens: a passed crate with a fingerprint is set, a failed one is cleared
    (its fingerprint null), an unobserved one stays."""
    put = results.where("passed").join(fingerprints, "crate").where("fingerprint is not null").select("crate", "fingerprint", F.lit(at).cast("bigint").alias("at"))
    return put.union(results.where("not passed").select("crate", F.lit(None).cast("string"), F.lit(at).cast("bigint")))


def with_greens(greens: DataFrame, results: DataFrame, fingerprints: DataFrame, at: int) -> DataFrame:
    """Greens after results (crate, passed)."""
    new = green_changes(results, fingerprints, at)
    return greens.join(new.select("crate").distinct(), "crate", "left_anti").select("crate", "fingerprint", "at").union(new.where("fingerprint is not null"))


def with_coverage(coverage: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage in which the tests of new have only their new lines."""
    return coverage.join(new.select("test_id").distinct(), "test_id", "left_anti").unionByName(new)

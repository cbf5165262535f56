"""Whole flows: from inputs to a plan, a run set, a report or a dashboard, and back into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import attribution, dashboard, fingerprint, flaky, history, hybrid, selection
from verdigris.sources.store import Store


def affected(members: DataFrame, edges: DataFrame, changed: DataFrame, root: str = "") -> selection.Plan:
    return selection.plan(members, edges, changed, root)


def crate_fingerprints(files: DataFrame, members: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """crate, fingerprint of all members; files: (crate, rel, digest)."""
    own = members.select(F.col("name").alias("crate")).distinct().join(fingerprint.own_digests(files), "crate", "left")
    return fingerprint.merkle(own, edges, scope)


def crates_to_run(plan: selection.Plan, members: DataFrame, files: DataFrame, edges: DataFrame, store: Store, scope: str, every: bool = False, no_cache: bool = False) -> DataFrame:
    """crate, run of the plan's candidates. Nothing is hashed where there are none."""
    some = selection.candidates(plan, members, every)
    if some.isEmpty():
        return some.withColumn("run", F.lit(False))
    return attribution.to_run(some, crate_fingerprints(files, members, edges, scope), store.load("greens"), no_cache)


def ingest(store: Store, crates: DataFrame, outcomes: DataFrame, fingerprints: DataFrame, at: int) -> DataFrame:
    """Adds a run's outcomes (id, passed, flaky, duration_ms) to the history and updates the greens of the crates that
    ran; returns their results (crate, passed)."""
    results = attribution.crate_results(crates, outcomes)
    seen = outcomes.withColumns({"ord": F.monotonically_increasing_id(), "at": F.lit(at).cast("bigint")})
    store.append(history=history.partial(seen, run=at), greens=history.green_changes(results, fingerprints, at))
    return results


def ingest_status(store: Store, crates: DataFrame, ok: bool, args: list[str], fingerprints: DataFrame, at: int) -> DataFrame:
    """As ingest(), for a run that gives one status only: no history is written."""
    results = attribution.aggregate_results(crates, ok, attribution.is_exhaustive(args))
    store.append(greens=history.green_changes(results, fingerprints, at))
    return results


def ingest_coverage(store: Store, coverage: DataFrame, base: str) -> None:
    """Replaces the lines of the tests in coverage (test_id, file, line), taken at the base revision."""
    store.append(coverage=coverage.withColumn("base", F.lit(base)))


def functions_to_run(items: DataFrame, aliases: DataFrame, hunks: DataFrame, tests: DataFrame, store: Store, base: str) -> DataFrame:
    """tests (test_id, crate) and must_run: one impact analysis for all crates, then selection by coverage."""
    impact = hybrid.analyze(items, aliases, hunks)
    return hybrid.run_set(impact, store.load("coverage"), tests, store.load("history"), base)


def covered_of(tests: DataFrame, store: Store) -> DataFrame:
    """The stored coverage of the given tests."""
    return store.load("coverage").join(tests.select("test_id").distinct(), "test_id", "left_semi")


def flaky_report(runs: DataFrame, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Scores with posteriors, and their one-row summary."""
    scores = flaky.score(runs, level, posterior=True)
    return scores, flaky.summary(scores)


def dashboard_rows(plan: selection.Plan, fingerprints: DataFrame, store: Store, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The dashboard's crates and header."""
    past = store.load("history")
    rows = dashboard.crates(plan.crates, fingerprints, store.load("greens"), past)
    return rows, dashboard.header(rows, past, level)



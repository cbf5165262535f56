import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.functions import bayes, stats
from verdigris.operators import flaky

# passes, fails, Wilson low and high, Jeffreys mean, low and high, reruns; computed independently.
GOLDEN = [
    (95, 5, 0.021543679, 0.111750469, 0.054455446, 0.019331812, 0.106100074, 59),
    (90, 10, 0.055229137, 0.174365662, 0.103960396, 0.052584675, 0.170123930, 29),
    (20, 0, 0.0, 0.161125158, 0.023809524, 0.000024246, 0.116638983, None),
    (100, 0, 0.0, 0.036993498, 0.004950495, 0.000004898, 0.024745270, None),
    (0, 100, 0.963006502, 1.0, 0.995049505, 0.975254730, 0.999995102, None),
    (1, 1, 0.094531206, 0.905468794, 0.5, 0.060830276, 0.939169724, 5),
]


def test_quantile():
    assert stats.normal_ppf(0.5) == 0
    assert stats.z_critical(0.95) == pytest.approx(1.959963986120195, abs=1e-12)
    assert stats.z_critical(0.9) == pytest.approx(1.644853625133699, abs=1e-12)
    assert stats.normal_ppf(0) == -math.inf and stats.normal_ppf(1) == math.inf
    p = [k / 1000 for k in range(1, 1000)]
    z = [stats.normal_ppf(x) for x in p]
    assert z == sorted(z)
    assert all(a == pytest.approx(-b, abs=1e-8) for a, b in zip(z, z[::-1], strict=True))


def test_quantile_column(spark):
    p = [0.0, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.99, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(stats.normal_ppf_column(F.col("p"))).collect()]
    assert got == pytest.approx([stats.normal_ppf(x) for x in p])


def test_scores_match_golden_values(spark):
    runs = spark.createDataFrame([(str(k), *g[:2]) for k, g in enumerate(GOLDEN)], "id string, passes bigint, fails bigint")
    got = {r["id"]: r for r in flaky.flat(flaky.score(runs, posterior=True)).collect()}
    for k, (_, fails, lo, hi, mean, plo, phi, reruns) in enumerate(GOLDEN):
        r = got[str(k)]
        assert (r["ci_low"], r["ci_high"], r["post_mean"], r["post_low"], r["post_high"]) == pytest.approx((lo, hi, mean, plo, phi), abs=1e-7)
        assert r["reruns_to_reproduce_95"] == reruns and r["proven_below"] == r["ci_high"]
        assert r["flake_rate"] == pytest.approx(fails / (r["passes"] + r["fails"]))


def test_verdicts_and_summary(spark, rows):
    runs = spark.createDataFrame([("a", 100, 0), ("b", 90, 10), ("c", 0, 100), ("none", 0, 0), ("b", 1, 1)], "id string, passes bigint, fails bigint")
    s = flaky.score(runs)
    assert rows(s, "id", "verdict") == [("a", "stable_pass"), ("b", "flaky"), ("b", "flaky"), ("c", "stable_fail"), ("none", "unknown")]
    assert rows(flaky.summary(s)) == [(5, 2, 1)]
    assert rows(flaky.flat(s).where("id = 'none'"), "flake_rate", "ci_low", "ci_high") == [(0.0, 0.0, 1.0)]
    text = flaky.as_text(s.withColumn("pos", F.monotonically_increasing_id()), "pos")
    assert text.splitlines()[0].startswith("FLAKY") and text.splitlines()[-1].startswith("ALWAYS FAILS c") and len(text.splitlines()) == 3
    assert '"verdict":"stable_fail"' in flaky.as_json(s.where("id = 'c'")).first()[0]


def test_level_one_gives_the_whole_interval(spark):
    r = flaky.flat(flaky.score(spark.createDataFrame([("a", 3, 1)], "id string, passes bigint, fails bigint"), level=1.0)).first()
    assert (r["ci_low"], r["ci_high"], r["reruns_to_reproduce_95"]) == (0.0, 1.0, 11)


def test_rerun_budget(spark):
    assert 298 <= stats.reruns(0.01) <= 300
    cases = [(0.01, 0.95), (1.0, 0.95), (0.0, 0.95), (1e-18, 0.95), (0.5, 1.0), (0.5, 0.0), (0.2, 0.5)]
    got = [r[0] for r in spark.createDataFrame(cases, "p double, g double").select(stats.required_reruns(F.col("p"), F.col("g"))).collect()]
    assert got == [stats.reruns(*c) for c in cases] and got[1:4] == [1, None, 1]
    for bad in (-0.1, 1.1, math.nan):
        with pytest.raises(ValueError):
            stats.unit_interval(bad)


def test_beta_identities():
    assert bayes.incomplete_beta(0.3, 1, 1)[0] == pytest.approx(0.3)
    assert bayes.incomplete_beta(0.5, 2, 2)[0] == pytest.approx(0.5)
    assert bayes.ln_gamma(5.0) == pytest.approx(math.log(24))
    for a, b in ((2, 5), (0.5, 0.5), (10, 3)):
        for p in (0.1, 0.5, 0.9):
            assert bayes.incomplete_beta(bayes.beta_quantile(p, a, b), a, b)[0] == pytest.approx(p, abs=1e-6)
    assert bayes.beta_quantile(np.array([0.0, 1.0]), 2, 3).tolist() == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 500), st.integers(0, 500))
def test_posterior_brackets_its_mean(fails, passes):
    a, b = fails + 0.5, passes + 0.5
    low, high = bayes.beta_quantile(np.array([0.025, 0.975]), a, b)
    assert 0 <= low <= a / (a + b) <= high <= 1


def test_margin_and_interval_bounds(spark):
    runs = spark.createDataFrame([(str(k), k, 50 - k) for k in range(51)], "id string, passes bigint, fails bigint")
    out = flaky.score(runs).select("ci.low", "ci.high", stats.margin(F.col("ci")).alias("m")).collect()
    assert all(0 <= r["low"] <= r["high"] <= 1 and r["m"] == pytest.approx((r["high"] - r["low"]) / 2) for r in out)

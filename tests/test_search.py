"""The search for the first failing row against a plain minimum."""

import random

import pytest

from verdigris.operators import ordering


@pytest.mark.parametrize("ways", [9, 64])
def test_search(spark, ways):
    r = random.Random(ways)
    keys = sorted(r.sample(range(-500, 4000), 300)) + [7000, 7000]
    df = spark.createDataFrame([(k, "n") for k in keys] + [(None, "x")], "k long, key string")
    for bound in (keys[0], keys[150], keys[150] + 1, 7000, 7001):
        want = min((k for k in keys if k >= bound), default=None)
        assert ordering.search_failing(df, "k", f"k >= {bound}", ways).collect() == [(want,)], bound
    assert ordering.search_failing(df.limit(0), "k", "true").collect() == [(None,)]

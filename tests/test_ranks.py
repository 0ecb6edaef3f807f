"""Exact percentiles by refined histograms."""

import math
import random

from waymark.operators import stats as st


def test_ranks_equal_a_sort(spark):
    rng = random.Random(8)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "close": [1.0 + i * 2**-52 for i in range(50)],
        "same": [3.25] * 40 + [3.5],
        "signs": [-2.0, -1.0, -0.5, 0.0, 0.0, 0.5, 1.0],
        "tiny": [5e-324, 1e-323, 0.0, -5e-324],
        "one": [7.0],
        "skewed": [0.1] * 900 + [rng.random() for _ in range(99)] + [1e9],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("same", None), ("none", None)]
    df = spark.createDataFrame(rows, "name string, value double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["name"]: r["percentile"] for r in st.nearest_rank(df, q).collect()}
        assert got == {k: sorted(vs)[max(math.ceil(q * len(vs)), 1) - 1] for k, vs in groups.items()}
    assert st.nearest_rank(df.limit(0), 0.95).count() == 0


def test_samples_are_not_shuffled(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'b') as name", "sqrt(id) as value")
    plan = st.nearest_rank(df, 0.95)._jdf.queryExecution().executedPlan().toString()
    # What the last histogram left is read back; the samples were met by broadcast.
    assert "SortMergeJoin" not in plan and {r["name"] for r in st.nearest_rank(df, 0.95).collect()} == {"a", "b"}

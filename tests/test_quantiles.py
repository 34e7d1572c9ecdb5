import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewise.operators.sequence import exact_quantiles, value_bin

QS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def test_radix_selection_equals_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": np.concatenate([rng.random(30_000), np.full(9_000, 0.5)]), "normal": rng.normal(size=501) * 1e6, "tiny": np.array([0.1]), "two": np.array([-1.0, 3.0]),
        "close": 1.0 + rng.random(4_000) * 1e-12, "ulps": np.cumsum(np.concatenate([[1.0], np.full(3_000, 2.0 ** -52)])), "huge": rng.normal(size=40) * 1e300, "small": rng.normal(size=40) * 1e-300,
        "signs": np.array([-0.0, 0.0, 0.0, -1e-320, 5e-324]), "same": np.full(50, 7.25), "powers": np.array([2.0 ** k for k in range(-60, 60)] + [np.nextafter(2.0 ** k, 0) for k in range(-60, 60)])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("hot", None), ("none", None), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r for r in exact_quantiles(df, "k", "v", QS).collect()}
    assert set(got) == {*groups, None} and got[None].c == 5.0
    for k, v in groups.items():
        want = np.percentile(v, [100 * q for q in QS.values()])
        assert [got[k][n] for n in QS] == pytest.approx(list(want), rel=1e-12, abs=0), k


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=True), min_size=2, max_size=60))
def test_bins_never_fall(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)], "v double")
    b = [r.b for r in df.orderBy("v").select(value_bin(F.col("v")).alias("b")).collect()]
    assert b == sorted(b)


def test_plan_has_no_sort_of_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") / 7).alias("v"))
    plan = exact_quantiles(df, "k", "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert exact_quantiles(df.limit(0), "k", "v", {"m": 0.5}).count() == 0

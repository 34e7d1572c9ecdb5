import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.functions import arrays
from tracewise.operators import distances, layers


def val(spark, expr, *cols, schema=None):
    df = spark.createDataFrame([cols], schema)
    return df.select(expr.alias("v")).first().v


def test_concentration(spark):
    s = "a array<double>"
    assert val(spark, arrays.concentration(F.col("a")), [1.0, 1.0, 1.0, 1.0], schema=s) == pytest.approx(0.25)
    assert val(spark, arrays.concentration(F.col("a")), [0.0, 0.0, 0.0], schema=s) == 0.0
    x = [0.3, 0.1, 0.5, 0.1]
    n, srt = len(x), sorted(x)
    gini_like = abs(2 * np.cumsum(srt).sum() / (n * sum(srt)) - 1)
    assert val(spark, arrays.concentration(F.col("a")), x, schema=s) == pytest.approx(gini_like)


def test_wasserstein_equal(spark):
    v = val(spark, arrays.wasserstein_sorted(F.array_sort("a"), F.array_sort("b")),
            [0.1, 0.7, 0.2], [0.3, 0.3, 0.4], schema="a array<double>, b array<double>")
    assert v == pytest.approx(0.2)


def test_wasserstein_unequal(spark):
    rows = [(1, 0.0, 1, 0), (1, 1.0, 1, 0), (1, 3.0, 1, 0), (1, 5.0, 0, 1), (1, 6.0, 0, 1)]
    df = spark.createDataFrame(rows, "k long, x double, a long, b long")
    assert distances.wasserstein_long(df, "k", "x", "a", "b").first().wasserstein == pytest.approx(4.1666667)


def test_wasserstein_shuffles_its_rows_once(spark):
    rng = np.random.default_rng(5)
    rows = [(k, None if rng.random() < 0.1 else float(rng.integers(0, 9)), *((1, 0) if rng.random() < 0.5 else (0, 1))) for k in [1, 2, 2, 3, None] for _ in range(30)] + [(4, 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "k long, x double, a long, b long")
    got = {h: {r.k: r.wasserstein for r in distances.wasserstein_long(df, "k", "x", "a", "b", hot_rows=h).collect()} for h in (1 << 20, 40, 0)}
    assert got[0].keys() == got[40].keys() == {1, 2, 3}
    assert got[1 << 20] == pytest.approx(got[0]) and got[40] == pytest.approx(got[0])  # all keys by position; key 2 alone
    plan = distances.wasserstein_long(df, "k", "x", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ExistingRDD" not in plan.replace("Scan ExistingRDD", "", 1)


def test_softmax_and_cosine(spark):
    x = [1.0, 2.0, 3.0]
    e = np.exp(np.array(x) - 3)
    sm = val(spark, arrays.softmax(F.col("a")), x, schema="a array<double>")
    assert sm == pytest.approx(list(e / e.sum()))
    mx, mn = arrays.softmax_extremes(F.col("a"))
    assert val(spark, mx, x, schema="a array<double>") == pytest.approx(max(e / e.sum()))
    assert val(spark, mn, x, schema="a array<double>") == pytest.approx(min(e / e.sum()))
    c = val(spark, arrays.cosine(F.col("a"), F.col("b")), [1.0, 0.0], [1.0, 1.0], schema="a array<double>, b array<double>")
    assert c == pytest.approx(1 / np.sqrt(2))
    assert val(spark, arrays.cosine(F.col("a"), F.col("b")), [1.0], [1.0, 1.0],
               schema="a array<double>, b array<double>") is None


def states(spark, n_layers, n_steps=2, dim=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(1, s, l, [float(v) for v in rng.normal(size=dim)]) for s in range(n_steps) for l in range(n_layers)]
    return spark.createDataFrame(rows, "sample_id long, step int, layer int, values array<float>")


def test_layer_packing_primary(spark):
    # 33 states (layers 0..32), start 24 -> layers 26, 28, 30, 32
    st = states(spark, 33)
    sel = sorted({r.layer for r in layers.selected_layers(st, "llava").collect()})
    assert sel == [26, 28, 30, 32]
    wide = layers.layer_shift(st, "llava").first().asDict()
    assert all(wide[f"feature_{i}"] != 0 for i in range(6))
    assert all(wide[f"feature_{i}"] == 0 for i in range(6, 30))
    assert 0 < wide["feature_3"] <= 1.0     # cosines start at slot n-1 = 3


def test_layer_fallback(spark):
    # 27 states (max layer 26), start 27 -> fallback layers 11, 13, ..., 25 -> 14 features
    st = states(spark, 27)
    sel = sorted({r.layer for r in layers.selected_layers(st, "paligemma").collect()})
    assert sel == list(range(11, 27, 2))
    wide = layers.layer_shift(st, "paligemma").first().asDict()
    assert sum(1 for i in range(30) if wide[f"feature_{i}"] != 0) == 14


def test_step_consistency_out_of_range(spark):
    st = states(spark, 1, n_steps=21)
    r = layers.step_consistency(st, "llava").first()
    assert (r.feature_62, r.feature_63) == (0.0, 0.0)


def test_step_consistency_sums_to_one(spark):
    st = states(spark, 1, n_steps=6)
    r = layers.step_consistency(st, "llm").first()
    assert r.feature_62 + r.feature_63 == pytest.approx(1.0)


def test_head_mean(spark):
    v = val(spark, arrays.head_mean(F.col("a"), 2), [1.0, 2.0, 3.0, 5.0], schema="a array<double>")
    assert v == pytest.approx([2.0, 3.5])

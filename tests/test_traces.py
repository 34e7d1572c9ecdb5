import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.operators import sequence, traces


def trace(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, step long, p_max double, p_min double")


def one(df):
    return df.collect()[0].asDict()


def test_one_step_gives_zeros(spark):
    t = trace(spark, [(1, 0, 0.9, 0.1)])
    c = one(traces.confidence_block(t))
    assert c["feature_67"] == 0 and c["feature_68"] == 0
    g = one(traces.gradient_features(t))
    assert g["mean_grad_max"] == 0 and g["max_grad_max"] == 0
    e = one(traces.entropy_and_counts(t))
    assert e["norm_entropy_max"] == 0
    w = one(traces.transition_metrics(t))
    assert all(w[k] == 0 for k in ("max_drop", "max_increase", "total_volatility", "num_significant_drops",
                                   "largest_window_drop"))


def test_slope(spark):
    t = trace(spark, [(1, 0, 0.9, 0.1), (1, 1, 0.8, 0.1), (1, 2, 0.6, 0.1)])
    assert one(traces.confidence_block(t))["feature_68"] == pytest.approx(-0.15)


def test_transition_window_drop_matches_convolution(spark):
    p = [0.9, 0.2, 0.8, 0.1, 0.7, 0.65]
    t = trace(spark, [(1, i, v, 0.0) for i, v in enumerate(p)])
    w = one(traces.transition_metrics(t))
    d = np.diff(p)
    conv = np.convolve(d, np.ones(3), "valid")
    assert w["largest_window_drop"] == pytest.approx(max(0, -min(conv.min(), 0)))
    assert w["max_drop"] == pytest.approx(min(0, d.min()))
    assert w["num_significant_drops"] == int((d < -0.3).sum())


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.random(37)
    t = trace(spark, [(7, i, float(v), 0.0) for i, v in enumerate(vals)])
    s = one(traces.trace_statistics(t))
    assert s["median"] == pytest.approx(np.median(vals))
    assert s["iqr"] == pytest.approx(np.percentile(vals, 75) - np.percentile(vals, 25))
    assert s["std"] == pytest.approx(np.std(vals))


def test_ordered_index_hot_key_spans_partitions(spark):
    # one key holds most rows: its index must still be dense and ordered
    data = [(0, i) for i in range(3000)] + [(k, i) for k in range(1, 50) for i in range(5)]
    df = spark.createDataFrame(data, "k long, o long")
    out = sequence.ordered_index(df, "k", ["o"], out="idx", num_partitions=8)
    hot = out.filter("k = 0").orderBy("o").select("idx").collect()
    assert [r.idx for r in hot] == list(range(3000))
    assert out.filter("k = 3").agg(F.max("idx")).first()[0] == 4
    # the hot key was spread over several range partitions
    parts = (df.repartitionByRange(8, "k", "o").filter("k = 0")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_running_sums(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(100)], "k long, o long, v long")
    out = sequence.ordered_index(df, "k", ["o"], out="idx", num_partitions=4, sums=["v"])
    got = {r.o: r.v_cum for r in out.collect()}
    assert got[99] == sum(range(100)) and got[10] == sum(range(11))


def test_with_leads(spark):
    t = trace(spark, [(1, i, float(i), 0.0) for i in range(5)])
    d = {r.step: (r.p_max_lead1, r.p_max_lead3) for r in traces.step_deltas(t, ("p_max",)).collect()}
    assert d[0] == (1.0, 3.0) and d[3] == (4.0, None) and d[4] == (None, None)


def test_row_features_equal_grouped(spark):
    rng = np.random.default_rng(3)
    p = [float(x) for x in rng.random(12)]
    t = trace(spark, [(1, i, v, v / 3) for i, v in enumerate(p)])
    g = one(traces.confidence_block(t))
    a = traces.trace_arrays(t)
    r = one(a.select(*[v.alias(k) for k, v in traces.row_features(F.col("feature_60")).items()]))
    for k in ("feature_66", "feature_67", "feature_68", "feature_69", "feature_70"):
        assert r[k] == pytest.approx(g[k])


def test_perplexity_ratio_zero_lengths(spark):
    t = trace(spark, [(1, 0, 0.5, 0.1), (1, 1, 0.25, 0.1)])
    lengths = spark.createDataFrame([(1, 0, 2)], "sample_id long, prompt_len int, gen_len int")
    r = one(traces.perplexity_ratio(t, lengths))
    # prompt length 0 -> prompt perplexity 1; generation: exp((ln2 + ln4) / 2)
    assert r["perplexity_ratio"] == pytest.approx(math.exp((math.log(2) + math.log(4)) / 2))

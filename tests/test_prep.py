import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.operators import features as feat
from tracewise.operators import learn, prep, report


def table(spark, n_per_class=(40, 12, 5), dim=3, seed=1):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c, n in enumerate(n_per_class):
        for _ in range(n):
            rows.append((i, f"c{c}", *[float(v) for v in rng.normal(c, 1, size=dim)]))
            i += 1
    return spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"x{j} double" for j in range(dim)))


def test_stratified_split_quota(spark):
    d = prep.stratified_split(table(spark), "id", "label", 0.2)
    got = {r.label: r.n for r in d.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"c0": math.ceil(40 * 0.2), "c1": math.ceil(12 * 0.2), "c2": math.ceil(5 * 0.2)}


def test_smote_balances_and_interpolates(spark):
    t = table(spark)
    out = prep.smote(t, "id", "label", ["x0", "x1", "x2"], k_max=15)
    counts = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"c0": 40, "c1": 40, "c2": 40}
    # synthetic points lie inside the class's bounding box (convex combinations)
    for c in ("c1", "c2"):
        orig = t.filter(F.col("label") == c).toPandas()
        syn = out.filter((F.col("label") == c) & F.col("is_synthetic")).toPandas()
        for j in ("x0", "x1", "x2"):
            assert syn[j].min() >= orig[j].min() - 1e-9 and syn[j].max() <= orig[j].max() + 1e-9


def test_scaler_zero_variance_and_groups(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (3.0, 5.0, 4.0)], "a double, b double, c double")
    st = prep.fit_scaler(df, ["a", "b", "c"])
    out = prep.apply_scaler(df, st, ["a", "b", "c"]).collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.b for r in out] == [0.0, 0.0]
    # one scaler equals per-group scalers (scaling is column-wise)
    st2 = prep.fit_scaler(df, ["a"])
    assert [r.a for r in prep.apply_scaler(df.select("a"), st2, ["a"]).collect()] == [-1.0, 1.0]


def test_encode_labels_alphabetical(spark):
    d = prep.encode_labels(table(spark), "label")
    assert {r.label: r.label_idx for r in d.select("label", "label_idx").distinct().collect()} == \
        {"c0": 0, "c1": 1, "c2": 2}


def test_parse_feature(spark):
    df = spark.createDataFrame([("[0.1, 0.3]",), ("[0.2]",), ("0.5",), (None,), ("[]",)], "v string")
    got = [r.p for r in df.select(feat.parse_feature(F.col("v")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.2) and got[1] == pytest.approx(0.2) and got[2] == 0.5
    assert got[3] is None and math.isnan(got[4])
    with pytest.raises(Exception):
        df.select(feat.parse_feature(F.col("v"), strict=True)).collect()


def test_feature_sets_and_matrix():
    cols = [f"feature_{i}" for i in range(74)]
    mc = feat.selected_features("multiclass", cols)
    assert "feature_62" in mc and "feature_65" in mc and "feature_64" not in mc and len(mc) == 70
    assert len(feat.selected_features("binary", cols)) == 65 and len(feat.selected_features("base", cols)) == 62


def test_matrix_columns_reference_count(spark):
    cols = [f"feature_{i}" for i in range(74) if i not in (64, 70, 72, 73)]
    df = spark.createDataFrame([tuple([0.0] * (len(cols) + len(feat.CHUNK_FEATURES)))],
                               ", ".join(f"{c} double" for c in cols + feat.CHUNK_FEATURES))
    df = feat.add_composites(df)
    assert len(feat.matrix_columns(df, reference_compat=True)) == 94
    assert len(feat.matrix_columns(df)) == 92


def test_assemble_zero_substitution(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    block = spark.createDataFrame([(1, 0.7)], "sample_id long, feature_66 double")
    out = {r.sample_id: r for r in feat.assemble(samples, [block], required=block).collect()}
    assert out[1].feature_66 == 0.7 and out[2].feature_66 == 0.0 and out[2].is_failed
    assert out[2].feature_60 == []


def test_fit_predict_importance(spark):
    t = prep.encode_labels(table(spark, (30, 30, 30)), "label")
    t = prep.with_class_weights(t, "label")
    m = learn.fit(t, ["x0", "x1", "x2"], "label_idx", "weight", max_iter=30)
    p = learn.predict(m, t, ["x0", "x1", "x2"], ["id", "label_idx"])
    acc = p.select(F.avg((F.col("pred") == F.col("label_idx")).cast("double"))).first()[0]
    assert acc > 0.6
    imp = learn.permutation_importance(m, t, ["x0", "x1", "x2"], "id", "label_idx")
    assert imp.count() == 3


def test_compare_models_equals_separate_fits(spark):
    t = prep.encode_labels(table(spark, (60, 50, 40)), "label").withColumn("is_test", F.col("id") % 4 == 0)
    t = t.withColumn("model", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).withColumn("weight", F.lit(1.0))
    lone = t.filter("label_idx = 0 and not is_test").withColumn("model", F.lit("one class"))
    t = t.withColumn("is_test", F.col("id") % 5 == 0)
    x = ["x0", "x1", "x2"]
    got = {r.group: r for r in learn.compare_models(t.unionByName(lone), "model", x).collect()}
    for g in ("a", "b"):
        part = t.filter(F.col("model") == g)
        m = learn.fit(part.filter("not is_test"), x, "label_idx", "weight")
        p = learn.predict(m, part.filter("is_test"), x, [F.col("label_idx").alias("y")])
        want = report.summary_metrics(p).first()
        assert got[g].error is None and abs(got[g].accuracy - want.accuracy) < 1e-9 and abs(got[g].macro_f1 - want.macro_f1) < 1e-9
        assert abs(got[g].weighted_f1 - want.weighted_f1) < 1e-9 and 0.5 < got[g].macro_auc <= 1
    assert got["one class"].accuracy is None and "two classes" in got["one class"].error


def test_importance_permutes_one_column_and_reports_groups(spark):
    t = prep.encode_labels(table(spark, (30, 30, 30)), "label").withColumn("weight", F.lit(1.0))
    named = t.select("id", "label_idx", "weight", F.col("x0").alias("feature_3"), F.lit(0.0).alias("feature_65"), F.col("x1").alias("feature_70"))
    cols = ["feature_3", "feature_65", "feature_70"]
    m = learn.fit(named, cols, "label_idx", "weight", max_iter=30)
    imp = learn.permutation_importance(m, named, cols, "id", "label_idx")
    by = {r.feature: r.importance for r in imp.collect()}
    assert set(by) == set(cols) and by["feature_65"] == 0.0 and by["feature_3"] > 0
    rows = report.importance_report(imp).collect()
    late = sorted((r["rank"], r.feature, r.group_name) for r in rows if r.section == "signals_62_73")
    assert late == [(1, "feature_70", "Perplexity/Confidence"), (2, "feature_65", "Attention Concentration")]
    assert {r.group_name for r in rows if r.section == "groups"} == {"signal_0_61", "signal_62_73"}


def test_copies_follow_the_weights(spark):
    t = prep.with_class_weights(table(spark, (400, 90, 10)), "label")
    n = {r.label: r["count"] for r in prep.weighted_copies(t, "id", "weight").groupBy("label").count().collect()}
    w = {r.label: r.weight for r in t.select("label", "weight").distinct().collect()}
    assert n["c0"] == 400  # the least weight: every row once
    for c, k in (("c1", 90), ("c2", 10)):
        r = w[c] / w["c0"]
        assert k * math.floor(r) <= n[c] <= k * math.ceil(r) and abs(n[c] - k * r) <= 3 * k ** 0.5


def test_network_takes_weights(spark):
    t = prep.with_class_weights(prep.encode_labels(table(spark, (60, 30, 30)), "label"), "label")
    with pytest.raises(ValueError):
        learn.fit(t, ["x0", "x1", "x2"], "label_idx", "weight", mlp_layers=[4])
    m = learn.fit(t, ["x0", "x1", "x2"], "label_idx", "weight", max_iter=40, mlp_layers=[6, 4], id_col="id")
    p = learn.predict(m, t, ["x0", "x1", "x2"], ["id", "label_idx"])
    assert p.select(F.avg((F.col("pred") == F.col("label_idx")).cast("double"))).first()[0] > 0.6

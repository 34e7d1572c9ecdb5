import pytest
from pyspark.sql import functions as F

from tracewise.operators import report, scores


def test_score_tie_rules(spark):
    df = spark.createDataFrame([(0.5,)], "s double")
    r = df.select(scores.label_v1(F.col("s")).alias("a"), scores.label_v2(F.col("s")).alias("b")).first()
    assert (r.a, r.b) == (1, 0)


def test_numeric_max(spark):
    df = spark.createDataFrame([("x", "1e-05"), ("x", "0.9")], "id string, score string")
    assert scores.best_score(df).first().best_score == 0.9


def test_rare_class_weights(spark):
    rows = [("a",)] * 4 + [("b",)] * 8 + [("c",)] * 88
    w = {r.label: r.weight for r in report.class_weights(spark.createDataFrame(rows, "label string"), "label").collect()}
    assert w["a"] == pytest.approx(100 / 4 * 3) and w["b"] == pytest.approx(100 / 8 * 2)
    assert w["c"] == pytest.approx(100 / 88)


def test_auc_with_tie(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.9, 0), (1, 0.4, 1), (1, 0.1, 0)], "g int, s double, y int")
    assert report.auc_by_group(df, "g", "s", "y").first().auc == pytest.approx(0.625)
    neg = df.withColumn("s", -F.col("s"))
    assert report.auc_by_group(neg, "g", "s", "y").first().auc == pytest.approx(0.375)


def test_weighted_recall_is_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)], "y int, pred int")
    s = report.summary_metrics(df).first()
    assert s.weighted_recall == pytest.approx(s.accuracy)


def test_token_f1(spark):
    pairs = spark.createDataFrame([(1, "a b b c", "b b d"), (2, "", "")], "id long, c string, r string")
    got = {r.id: r.score for r in scores.token_f1(pairs, "id", "c", "r").collect()}
    assert got[1] == pytest.approx(2 * 2 / 7) and got[2] == 0.0


def test_confusion_grid_complete(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "y int, pred int")
    assert report.confusion(df).count() == 4

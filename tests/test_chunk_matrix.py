"""The chunk matrix: texts meet orders and features before they are chunks (F9), signals once per sample (F8), fits over packed blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.operators import blocks, chunks, features, labelling, learn, matching, permutation, prep
from tracewise.plans import learn_queries

OWN = ("a", "b")
COLS = ("s0", "a", "s1", "b", "s2")


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    names, rows = ["CORRECT", "CATEGORY_HALLUC", "RELATION_HALLUC"], []
    for i in range(160):
        s = [float(v) for v in rng.normal(size=2)] + [4.0]
        c = [(names[int(rng.integers(0, 3))], float(rng.normal()), float(k % 2)) for k in range(int(rng.integers(0, 7)))]
        rows.append((str(i) if i else None, f"m{i % 2}" if i % 9 else None, i % 4 == 0, s, [(y, a + s[0] * (y == "CORRECT") + 2 * (y == names[1]), b) for y, a, b in c]))
    d = spark.createDataFrame(rows, "id string, `group` string, is_test boolean, shared array<double>, chunks array<struct<label:string,a:double,b:double>>").repartition(3)
    m = prep.encode_labels(blocks.pack(d, sorted(matching.LABELS), ("s0", "s1", "s2"), OWN, COLS), "label")
    assert m.classes == ("CATEGORY_HALLUC", "CORRECT", "RELATION_HALLUC") and m.counts.sum() == sum(len(r[4]) for r in rows)
    return m


def _model_sides(m):
    scaled = prep.apply_scaler(m, prep.fit_scaler(m.side(False), COLS), COLS)
    return prep.with_class_weights(scaled.side(False), "label"), scaled.side(True)


def test_scaler_and_weights_are_those_of_the_rows(matrix):
    rows, train = matrix.side(False).table(), matrix.side(False)
    mean, sd = prep.fit_scaler(train, COLS)
    want = prep.fit_scaler(rows, list(COLS)).first()
    for i, c in zip(np.argsort(train.order).tolist(), [*train.shared, *train.own]):
        assert COLS[i] == c
    for k, c in enumerate([*train.shared, *train.own]):
        assert mean[k] == pytest.approx(want[f"{c}__mu"], abs=1e-12) and sd[k] == pytest.approx(want[f"{c}__sd"], abs=1e-12)
    assert sd[2] == 0 and mean[2] == 4.0
    weighted = prep.with_class_weights(train, "label").table()
    assert weighted.select("label", "weight").distinct().collect()
    want = {r.label: r.weight for r in prep.with_class_weights(rows.drop("weight"), "label").select("label", "weight").distinct().collect()}
    assert {r.label: r.weight for r in weighted.select("label", "weight").distinct().collect()} == pytest.approx(want)


def test_fit_and_predictions_are_those_of_spark_ml(matrix):
    train, test = _model_sides(matrix)
    for steps in (4, 50):
        mine = learn.fit(train, list(COLS), "label_idx", "weight", max_iter=steps)
        theirs = learn.fit(train.table(), list(COLS), "label_idx", "weight", max_iter=steps)
        a, b = mine.stages[-1], theirs.stages[-1]
        np.testing.assert_allclose(a.coefficientMatrix.toArray(), b.coefficientMatrix.toArray(), atol=1e-7)
        np.testing.assert_allclose(a.interceptVector.toArray(), b.interceptVector.toArray(), atol=1e-7)
    keep = ["row_id", "label", "label_idx"]
    got = {r.row_id: r for r in learn.predict(mine, test, list(COLS), keep).collect()}
    want = learn.predict(theirs, test.table(), list(COLS), keep).collect()
    assert len(got) == len(want) == test.counts.sum() and "0" in got
    for r in want:
        g = got[r.row_id]
        assert (g.label, g.label_idx, g.pred) == (r.label, r.label_idx, r.pred)
        np.testing.assert_allclose(g.probs, r.probs, atol=1e-7)


def test_one_class_is_predicted_always(matrix):
    one = matrix.side(False)
    one = blocks.replace(one, frame=one.frame.limit(0))
    assert one.counts.tolist() == [0, 0, 0]
    coef = np.zeros((3, 5))
    bias = np.array([0.0, np.inf, 0.0])
    p = learn.predict(learn._logistic_model(coef, bias), matrix.side(True), list(COLS), ["y"]).collect()
    assert {r.pred for r in p} == {1} and p[0].probs == [0.0, 1.0, 0.0]


def test_importance_is_that_of_the_rows(spark, matrix):
    train, test = _model_sides(matrix)
    m = learn.fit(train, list(COLS), "label_idx", "weight", max_iter=30)
    want = {r.feature: (r.importance, r.baseline_accuracy) for r in learn.permutation_importance(m, test.table(), list(COLS), "row_id", "label_idx").collect()}
    got = {r.feature: (r.importance, r.baseline_accuracy) for r in learn.permutation_importance(m, test, list(COLS), "row_id", "label_idx").collect()}
    assert got.keys() == set(COLS) and all(got[c] == pytest.approx(want[c], abs=1e-12) for c in COLS)
    lr = m.stages[-1]
    coef, bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    parts = permutation.importance(test, lambda x: coef @ x + bias[:, None], coef, group_rows=20)  # many groups a column
    n = int(test.counts.sum())
    found = {r.j: (r.hits, r.n) for r in parts.collect()}
    assert all(found[j] == (round((want[c][1] - want[c][0]) * n), n) for j, c in enumerate(COLS))


def test_models_of_groups_are_those_of_the_rows(matrix):
    scaled = prep.apply_scaler(matrix, prep.fit_scaler(matrix.side(False), COLS), COLS)
    weights = prep.with_class_weights(scaled.side(False), "label").weights
    cols = [c for c in COLS if c != "s2"]
    got = {r.group: r for r in learn.compare_models(blocks.replace(scaled, weights=weights), "model_name", list(COLS), max_iter=4).collect()}
    rows = scaled.side(False).table().withColumn("is_test", F.lit(False)).unionByName(scaled.side(True).table().withColumn("is_test", F.lit(True)))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("label_idx") + 1))
    want = {r.group: r for r in learn.compare_models(rows, "model_name", cols, max_iter=4).collect()}
    assert got.keys() == want.keys() == {"", "m0", "m1"}
    for g, r in want.items():
        for k, v in r.asDict().items():
            assert got[g][k] == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v), (g, k)


def test_blocks_hold_a_sample_once(spark):
    rows = [(str(i), "m", False, [float(i // 4), 1.0], [("CORRECT", 1.0 * k, 0.0) for k in range(5)]) for i in range(8)]
    d = spark.createDataFrame(rows, "id string, `group` string, is_test boolean, shared array<double>, chunks array<struct<label:string,a:double,b:double>>").coalesce(1)
    b = blocks.Block.read(blocks.pa.scalar(bytes(blocks.pack(d, ("CORRECT",), ("s0", "s1"), OWN, ("s0", "s1", "a", "b")).frame.first().block), blocks.pa.binary()))
    assert b.shared.shape == (2, 2) and b.own.shape == (2, 40) and b.dense().shape == (4, 40)


def test_chunk_numbers_of_a_batch(spark):
    texts = ["A red ring on a blue plate. The old dogs holding the leaves!", "the of and", "Ring RING ring  ring's\tring　x²", "quickly"]
    g = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id long, generated_description string")
    r = spark.createDataFrame([(0, 0, "A red ring on a widget."), (2, 0, "dogs")], "sample_id long, gt_idx int, gt_text string")
    li = labelling.prepare(g, r)
    fields = ("chunk_label", *features.CHUNK_FEATURES)
    mine = chunks.chunk_rows(matching.labelled_texts(li.texts, li.text_col, fields=fields))
    theirs = chunks.chunk_features(matching.with_labels(li.samples)).select("sample_id", "chunk_idx", "chunk_label", *[F.col(c).cast("double").alias(c) for c in features.CHUNK_FEATURES])
    assert sorted(mine.collect()) == sorted(theirs.collect()) and mine.count() > 8


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few orders, one repeated, one of no customer with features, lines without order."""
    at = str(tmp_path_factory.mktemp("tables"))
    put = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put([(k, n) for k, n in enumerate(["small red ring", "blue plate", "old dog", "steel box"])], "p_partkey long, p_name string", "part")
    put([(o, n, (o + n) % 4, o + n, float(n), 10.0 * n, 0.1, 0.0, "N", "O", "1995-01-01") for o in range(6) for n in range(1, 5)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string", "lineitem")
    put([(0, 1, "1-URGENT"), (1, 1, "2-HIGH"), (1, 2, "5-LOW"), (2, 9, "5-LOW"), (3, None, "5-LOW"), (4, 0, None)], "o_orderkey long, o_custkey long, o_orderpriority string", "orders")
    put([(e, e % 3, e, 0.1 * e) for e in range(12)], "event_id long, user_id long, ts long, value double", "events")
    put([(i, "a b a") for i in range(2)], "doc_id long, text string", "documents")
    put([(v, [0.1 * v, 0.2, -0.3, 0.4] * 4) for v in range(40)], "vec_id long, embedding array<float>", "embeddings")
    return at


def test_no_chunk_is_shuffled(spark, tables):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build in (learn_queries.chunk_dataset, learn_queries.multiclass_matrix):
            plan = build(spark, tables)._jdf.queryExecution().executedPlan().toString()
            above = plan.split("ArrowEvalPython")[0]
            assert "Generate" in above and "Exchange" not in above and "from_json" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_matrix_rows_are_those_of_the_dataset(spark, tables):
    d = learn_queries.chunk_dataset(spark, tables)
    assert d.filter("sample_id = 1").select("o_custkey").distinct().count() == 2 and d.filter("sample_id = 5 AND model_name IS NULL").count() > 0
    p = features.preprocess(d, "multiclass")
    cols = features.matrix_columns(p, "multiclass")
    want = p.select("sample_id", "chunk_idx", "chunk_label", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.lit(len(cols)).alias("n_columns"))
    got = learn_queries.multiclass_matrix(spark, tables)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert learn_queries._chunk_matrix(spark, tables)[0].counts.sum() == got.count()

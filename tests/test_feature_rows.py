import pytest
from pyspark.sql import functions as F

from tracewise.operators import traces
from tracewise.plans import learn_queries
from tracewise.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_feature_rows_carry_blocks(spark):
    rows = {r.sample_id: r for r in learn_queries._feature_rows(spark, SF).collect()}
    conf = {r.sample_id: r for r in traces.confidence_block(fixtures.prob_trace(spark, SF)).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert set(rows) == set(conf)
    for sid, r in rows.items():
        if sid in docs:
            assert not r.is_failed
            for k in ("feature_66", "feature_67", "feature_68", "feature_69", "feature_70"):
                assert r[k] == pytest.approx(conf[sid][k])
            assert len(r.feature_60) > 0
        else:
            # no generated text for this sample: kept as zeros with empty text
            assert r.is_failed and r.feature_66 == 0.0 and r.generated_description == "" and r.feature_60 == []
    assert len(rows[next(iter(rows))].asDict()) == 1 + 74 + 3 + 1 + 1


def test_numbers_are_not_parsed_from_text(spark):
    """A numeric column is taken as it is; only text goes through the parser, with equal results."""
    from pyspark.sql import functions as F

    from tracewise.operators import features as feat
    df = spark.createDataFrame([(0.1, 7, "[1.0, 3.0]"), (float("nan"), None, "2.5"), (1e-320, -1, "[]")], "feature_0 double, feature_1 long, feature_60 string")
    out = feat.preprocess(df, "binary")
    same = df.select(*[feat.parse_feature(F.col(c)).alias(c) for c in df.columns])
    assert [tuple(map(str, r)) for r in out.collect()] == [tuple(map(str, r)) for r in same.collect()]
    plan = out.select("feature_0", "feature_1")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "AS string" not in plan

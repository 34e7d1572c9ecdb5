import os

import pytest
from pyspark.sql import functions as F

from tracewise.operators import traces, truth
from tracewise.streaming import incremental


def test_trace_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "src")
    rows = [(i, [0.9, 0.5 + i / 100, 0.2, 0.7][: 2 + i % 3], [0.1, 0.1, 0.1, 0.1][: 2 + i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id long, p_max array<double>, p_min array<double>")
    df.limit(6).write.parquet(os.path.join(src, "a"))
    df.subtract(df.limit(6)).write.mode("append").parquet(os.path.join(src, "b"))
    q = incremental.start_trace_features(spark, os.path.join(src, "*"), df.schema, os.path.join(scratch, "out"),
                                         os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "out")).orderBy("sample_id").collect()
    feats = traces.row_features(F.col("p_max"))
    want = df.select("sample_id", *[v.alias(k) for k, v in feats.items()]).orderBy("sample_id").collect()
    assert len(got) == 12
    for g, w in zip(got, want):
        for k in ("feature_66", "feature_68", "median", "largest_window_drop"):
            assert g[k] == pytest.approx(w[k])


def test_truth_enrichment_stream(spark, scratch):
    src = os.path.join(scratch, "csv")
    os.makedirs(src)
    for name, files in (("m1.csv", ["a.jpg", "b.jpg"]), ("m2.csv", ["z.jpg"])):
        with open(os.path.join(src, name), "w") as f:
            f.write("image_filename,feature_0\n" + "".join(f"{x},1.0\n" for x in files))
    tr = spark.createDataFrame([("a.jpg", "cap a"), ("z.jpg", "cap z")], "image_filename string, gt string")
    schema = "image_filename string, feature_0 string"
    from pyspark.sql.types import StructType
    q = incremental.start_truth_enrichment(spark, src, StructType.fromDDL(schema), tr, "image_filename",
                                           os.path.join(scratch, "out"), os.path.join(scratch, "ck"),
                                           {"ground_truth": F.col("gt")})
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(scratch, "out"))
    got = {(r.source_file, r.image_filename): r.ground_truth for r in out.collect()}
    assert got == {("m1.csv", "a.jpg"): "cap a", ("m1.csv", "b.jpg"): "", ("m2.csv", "z.jpg"): "cap z"}
    batch = truth.left_join_truth(spark.read.option("header", True).csv(src), tr, "image_filename",
                                  {"ground_truth": F.col("gt")})
    assert sorted(r.ground_truth for r in batch.collect()) == sorted(got.values())


def _enrich(spark, scratch, src, tr, out="out", ck="ck", **more):
    from pyspark.sql.types import StructType
    q = incremental.start_truth_enrichment(spark, src, StructType.fromDDL("image_filename string, feature_0 string"), tr, "image_filename",
                                           os.path.join(scratch, out), os.path.join(scratch, ck), {"ground_truth": F.col("gt")}, **more)
    q.awaitTermination(120)
    return sorted((r.image_filename, r.ground_truth) for r in spark.read.parquet(os.path.join(scratch, out)).collect())


def test_a_batch_run_again_writes_no_row_twice(spark, scratch):
    """The commit record of the last batch is lost, as after a crash between the write and the commit: the batch runs again."""
    import shutil
    src = os.path.join(scratch, "csv")
    os.makedirs(src)
    tr = spark.createDataFrame([("a.jpg", "cap a")], "image_filename string, gt string")
    for name in ("m1", "m2", "m3"):
        with open(os.path.join(src, f"{name}.csv"), "w") as f:
            f.write(f"image_filename,feature_0\na.jpg,1.0\n{name}.jpg,2.0\n")
    want = sorted([("a.jpg", "cap a")] * 3 + [(f"{n}.jpg", "") for n in ("m1", "m2", "m3")])
    assert _enrich(spark, scratch, src, tr, max_files_per_trigger=1) == want
    commits = os.path.join(scratch, "ck", "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    assert last == 2
    kept = os.path.join(scratch, "ck2")
    shutil.copytree(os.path.join(scratch, "ck"), kept, ignore=lambda d, names: [n for n in names if d == commits and n.lstrip(".").split(".")[0] == str(last)])
    assert _enrich(spark, scratch, src, tr, ck="ck2", max_files_per_trigger=1) == want
    # a restart goes on where the query stopped
    with open(os.path.join(src, "m4.csv"), "w") as f:
        f.write("image_filename,feature_0\na.jpg,3.0\n")
    assert _enrich(spark, scratch, src, tr, ck="ck2") == sorted([*want, ("a.jpg", "cap a")])

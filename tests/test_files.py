import os

import pytest

from pyspark.sql import functions as F

from tracewise.sources import files


def _csv(path, header, rows):
    with open(path, "w") as f:
        f.write(header + "\n" + "".join(r + "\n" for r in rows))


def test_feature_folder_skips_and_names(spark, scratch):
    _csv(os.path.join(scratch, "image_signal_features_llava_mscoco_with_gt.csv"),
         "feature_0,image_filename,ground_truth_1", ["0.5,a.jpg,cap"])
    _csv(os.path.join(scratch, "bad.csv"), "feature_0,image_filename", ["0.1,b.jpg"])
    df, st = files.load_feature_folder(spark, scratch, "mscoco", prefix="image_signal_features_")
    assert [r.model_name for r in df.collect()] == ["llava_mscoco"]
    assert {os.path.basename(r.path): r.loaded for r in st.collect()} == \
        {"image_signal_features_llava_mscoco_with_gt.csv": True, "bad.csv": False}


def test_results_log_schema_union(spark, scratch):
    p = os.path.join(scratch, "results")
    files.append_results(spark, {"model": "a", "accuracy": 0.5}, p)
    log = files.append_results(spark, {"model": "b", "f1": 0.4}, p)
    assert set(log.columns) == {"model", "accuracy", "f1"} and log.count() == 2


def test_text_sink_one_line_per_row(spark, scratch):
    df = spark.createDataFrame([("a\nb",), ("c\rd ",)], "t string")
    files.write_text_column(df, "t", os.path.join(scratch, "txt"), strip_ends=True)
    lines = sorted(spark.read.text(os.path.join(scratch, "txt")).collect(), key=lambda r: r.value)
    assert [r.value for r in lines] == ["a b", "c d"]


def test_feature_csv_roundtrip(spark, scratch):
    df = spark.createDataFrame([(1, [0.1, 0.3], [0.2], 0.5)],
                               "sample_id long, feature_60 array<double>, feature_61 array<double>, feature_62 double")
    p = os.path.join(scratch, "fcsv")
    files.write_feature_csv(df, p, mode="overwrite")
    back = files.load_features(spark, p).first()
    assert back.feature_60 == "[0.1,0.3]"


def test_bundle_truth_folder_and_model(spark, scratch):
    import json as _json
    df = spark.createDataFrame([(1, "a.jpg", "m1.csv", "cap"), (2, "b.jpg", "m2.csv", "")],
                               "sample_id long, image_filename string, source_file string, ground_truth string")
    files.write_feature_bundle(df, os.path.join(scratch, "bundle"), {"model": "m", "n": 2})
    meta = _json.loads(spark.read.text(os.path.join(scratch, "bundle", "metadata")).first().value)
    assert meta["model"] == "m" and "extraction_timestamp" in meta
    files.write_truth_joined(df, os.path.join(scratch, "joined"))
    parts = sorted(d for d in os.listdir(os.path.join(scratch, "joined")) if d.startswith("source_file="))
    assert parts == ["source_file=m1.csv", "source_file=m2.csv"]
    from tracewise.operators import learn
    t = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.1, 0), (0.9, 1)], "x double, label_idx int")
    m = learn.fit(t, ["x"], "label_idx", None, family="binomial", max_iter=5)
    files.save_model(m, t.groupBy("label_idx").count(), os.path.join(scratch, "model"))
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(os.path.join(scratch, "model", "model")).stages


def test_folder_pass_lists_damaged_files_and_goes_on(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    for name, text in {"good.csv": 'id,t\n1,"a, ""b""\nc"\n2,x\n', "wide.csv": "id,extra\n1,z\n", "long.csv": "id,t\n1,x\n2,y,z\n", "short.csv": "id,t\n1\n",
                       "nokey.csv": "name,t\n1,x\n", "twice.csv": "id,t,T\n1,x,y\n"}.items():
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    tr = spark.createDataFrame([("1", "one")], "id string, gt string")
    got = {r.source_file: (r.n_rows, r.matched, r.error) for r in files.enrich_folder(
        spark, src, tr, "id", {"ground_truth": F.col("gt")}, os.path.join(scratch, "out")).collect()}
    assert got == {"good.csv": (2, 1, None), "wide.csv": (1, 1, None), "long.csv": (2, None, "1 damaged rows"), "short.csv": (1, None, "1 damaged rows"),
                   "nokey.csv": (None, None, "no column id"), "twice.csv": (None, None, "a column is named twice")}
    out = spark.read.option("mergeSchema", True).parquet(os.path.join(scratch, "out")).collect()
    assert sorted((r.source_file, r.id, r.ground_truth) for r in out) == [("good.csv", "1", "one"), ("good.csv", "2", ""), ("wide.csv", "1", "one")]
    assert [r.t for r in out if r.source_file == "good.csv" and r.id == "1"] == ['a, "b"\nc']


def test_reference_captions_need_their_columns(spark, scratch):
    from tracewise.operators import truth
    with open(os.path.join(scratch, "a.csv"), "w") as f:
        f.write("image_filename,generated_description\na.jpg,first\nb.jpg,\na.jpg,last\n")
    got = {r.image_filename: r.ground_truth for r in truth.reference_captions(spark, os.path.join(scratch, "a.csv")).collect()}
    assert got == {"a.jpg": "last", "b.jpg": ""}
    with open(os.path.join(scratch, "b.csv"), "w") as f:
        f.write("image_filename,caption\na.jpg,first\n")
    with pytest.raises(ValueError, match="generated_description"):
        truth.reference_captions(spark, os.path.join(scratch, "b.csv"))


def test_a_run_written_twice_is_in_the_log_once(spark, scratch):
    path = os.path.join(scratch, "log")
    rows = spark.createDataFrame([("m", 1.0)], "model string, f1 double")
    for run in ("r1", "r2", "r1"):
        log = files.append_result_rows(rows, path, run)
    assert log.count() == 2


def test_reference_caption_rows_spread_over_files(spark, tmp_path, monkeypatch):
    """The last caption of a file name wins although its rows lie in several files, none of them longer than asked for."""
    from pathlib import Path

    from tracewise.plans import io_queries
    from tracewise.plans.registry import all_queries
    from tracewise.sources import fixtures
    monkeypatch.setattr(io_queries, "CSV_FILE_ROWS", 3)
    monkeypatch.setattr(io_queries, "_folder", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(fixtures, "coco_images", lambda s, sf: s.range(1, 9).selectExpr("id", "concat('img_', id, '.jpg') file_name"))
    monkeypatch.setattr(fixtures, "image_features", lambda s, sf: s.range(1, 10).selectExpr("concat('img_', id) image_name", "concat('img_', id, '.jpg') image_filename"))
    rest = [f"0 AS {c}" for c in fixtures.ANN_ORDER[1:]]
    monkeypatch.setattr(fixtures, "coco_captions", lambda s, sf: s.range(1, 81).selectExpr("id % 8 + 1 AS image_id", "concat('caption', id) AS caption", "id AS l_linenumber", *rest))
    got = {r.image_filename: r.ground_truth for r in all_queries()["reference_caption_csv"].build(spark, "").collect()}
    assert got == {f"img_{i % 8 + 1}.jpg": f"caption{i}" for i in range(73, 81)} | {"img_9.jpg": ""}
    lines = [len(p.read_text().splitlines()) - 1 for p in Path(tmp_path, "captions").glob("*.csv")]
    assert sum(lines) == 80 and max(lines) <= 3

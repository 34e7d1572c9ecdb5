"""Edges that real inputs have: quoted CSV, file order, one head, empty trace, lone class, plural nouns, unset folder."""

import csv
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracewise import session
from tracewise.functions.arrays import head_mean
from tracewise.operators import labelling, layers, prep, samples, tagger, traces
from tracewise.sources import files


def test_csv_with_quotes_commas_and_newlines(spark, scratch):
    rows = [["a.jpg", 'He said "hi", twice\nthen left', "0.5"], ["b.jpg", "plain", "1.5"]]
    for name in ("one_with_gt.csv", "two_with_gt.csv"):
        with open(os.path.join(scratch, name), "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["image_filename", "ground_truth_1", "feature, 0"])
            w.writerows(rows)
    df, status = files.load_feature_folder(spark, scratch, "mscoco")
    got = sorted((r.model_name, r.image_filename, r.ground_truth_1, r["feature, 0"]) for r in df.collect())
    assert got == sorted((m, *r) for m in ("one", "two") for r in rows)
    assert [r.loaded for r in status.collect()] == [True, True]
    out = os.path.join(scratch, "out")
    files.write_feature_csv(df.drop("feature, 0"), out)
    back = files.load_features(spark, out).select("image_filename", "ground_truth_1").collect()
    assert sorted(tuple(r) for r in back) == sorted(tuple(r[:2]) for r in rows + rows)


def test_coqa_keeps_file_order(spark, scratch):
    ids = ["zeta", "alpha", "mid", "beta", "omega"]
    turn = lambda i, k: {"input_text": f"{i}{k}", "span_start": 0}
    data = [{"id": i, "story": f"Story {i}.", "questions": [turn(i, k) for k in range(3)], "answers": [turn(i, k) for k in range(3)],
             "additional_answers": {str(n): [turn(i, k) for k in range(3)] for n in range(3)}} for i in ids]
    path = os.path.join(scratch, "coqa.json")
    with open(path, "w") as f:
        json.dump({"data": data}, f, indent=1)
    got = [r.question for r in samples.load_qa_dataset(spark, "coqa", path).orderBy("idx").collect()]
    assert got == [f"{i}{k}" for i in ids for k in range(3)]


def test_parquet_files_keep_their_order(spark, scratch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"question": ["first", "second"]}), os.path.join(scratch, "a.parquet"))
    pq.write_table(pa.table({"question": [f"later {k}" for k in range(5000)]}), os.path.join(scratch, "b.parquet"))
    got = samples.load_qa_dataset(spark, "truthfulqa", scratch, max_samples=4).orderBy("idx").collect()
    assert [r.question for r in got] == ["first", "second", "later 0", "later 1"]
    assert got[0].name == "truthfulqa_sample_0"


def test_one_attention_head(spark):
    df = spark.createDataFrame([([0.1, 0.3, 0.6],)], "v array<double>")
    one, two = df.select(head_mean(F.col("v"), 1), head_mean(F.concat("v", "v"), 2)).first()
    assert one == [0.1, 0.3, 0.6] and two == pytest.approx(one)


def test_empty_trace_has_zero_features(spark):
    df = spark.createDataFrame([([],), ([0.5, 0.25],)], "p array<double>")
    rows = df.select(*[v.alias(k) for k, v in traces.row_features(F.col("p")).items()]).collect()
    assert all(v == 0 for v in rows[0]) and any(v != 0 for v in rows[1])


def test_unequal_layer_sizes_fail_the_sample(spark):
    rows = [(s, 0, k, [1.0, 2.0, float(k)] if s == 1 or k < 3 else [1.0]) for s in (1, 2) for k in range(5)]
    df = spark.createDataFrame(rows, "sample_id long, step int, layer int, values array<float>")
    assert {r.sample_id for r in layers.layer_shift_long(df).collect()} == {1}


def test_smote_lone_row_and_small_buckets(spark):
    rows = [(i, "a", float(i)) for i in range(6)] + [(100, "b", 7.0)] + [(200 + i, "c", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, label string, f_0 double")
    out = prep.smote(df, "id", "label", ["f_0"], leaf_rows=2).collect()
    assert {k: sum(r.label == k for r in out) for k in "abc"} == {"a": 6, "b": 6, "c": 6}
    assert {r.f_0 for r in out if r.label == "b"} == {7.0}
    assert all(0 <= r.f_0 <= 3 for r in out if r.label == "c")


def test_general_nouns_and_lemmas(spark):
    df = spark.createDataFrame([(1, "A tall man rides a brown horse near two dogs.")], "id long, text string")
    t = {r.text: (r.pos, r.lemma) for r in tagger.tag(df, ["id"]).collect()}
    assert t["man"] == ("NOUN", "man") and t["dogs"] == ("NOUN", "dog") and t["horse"] == ("NOUN", "horse")
    assert t["two"][0] == "X" and t["near"][0] == "ADP" and t["."][0] == "PUNCT"


@pytest.mark.parametrize("said, truth", [("men", "man"), ("man", "men"), ("mice", "mouse"), ("geese", "goose"), ("boxes", "box"), ("puppies", "puppy")])
def test_plural_and_singular_are_the_same_object(spark, said, truth):
    gen = spark.createDataFrame([(1, f"The {said}.")], "sample_id long, generated_description string")
    refs = spark.createDataFrame([(1, 0, f"The {truth}.")], "sample_id long, gt_idx int, gt_text string")
    labels = labelling.label(labelling.prepare(gen, refs), fuzzy=False).collect()
    assert [r.chunk_label for r in labels if r.chunk_type == "object"] == ["CORRECT"]


def test_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)

import json
import os

from pyspark.sql import functions as F

from tracewise.functions.lexicons import synonym_map
from tracewise.operators import truth


def test_category_summary_first_appearance(spark):
    ann = spark.createDataFrame([("f", "dog", 0), ("f", "cat", 1), ("f", "dog", 2)],
                                "file_name string, category string, pos int")
    assert truth.category_summary(ann, ["pos"]).first().ground_truth == "dog(2), cat"


def test_last_row_wins(spark):
    df = spark.createDataFrame([("a.jpg", "first", 0), ("a.jpg", "second", 1)], "f string, d string, pos int")
    assert truth.last_per_key(df, "f", "d", ["pos"]).first().d == "second"


def test_coco_tables_and_default_category(spark, scratch):
    data = {"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],
            "annotations": [{"image_id": 1, "category_id": 5, "bbox": [0.0, 1.0], "area": 2.0},
                            {"image_id": 9, "category_id": 5, "bbox": [0.0], "area": 1.0}],
            "categories": [{"id": 4, "name": "cat"}]}
    p = os.path.join(scratch, "coco.json")
    open(p, "w").write(json.dumps(data))
    images, ann, cats, kind = truth.coco_tables(spark, p)
    assert kind == "instances"
    a = truth.with_category_names(truth.annotations_by_file(images, ann), cats).collect()
    assert len(a) == 1 and a[0].category == "category_5" and a[0].file_name == "a.jpg"


def test_unmatched_truth_is_empty(spark):
    feats = spark.createDataFrame([("a.jpg",), ("z.jpg",)], "image_filename string")
    tr = spark.createDataFrame([("a.jpg", "cap")], "image_filename string, c string")
    j = {r.image_filename: (r.ground_truth, r.gt_matched)
         for r in truth.left_join_truth(feats, tr, "image_filename", {"ground_truth": F.col("c")}).collect()}
    assert j == {"a.jpg": ("cap", True), "z.jpg": ("", False)}
    rep = truth.match_report(truth.left_join_truth(feats, tr, "image_filename", {"ground_truth": F.col("c")})).first()
    assert (rep.matched, rep.unmatched, rep.match_rate) == (1, 1, 50.0)


def test_synonym_collisions():
    m = synonym_map()
    assert (m["vessel"], m["glass"], m["pet"], m["seat"], m["opening"]) == ("bottle", "window", "cat", "bench", "door")
    assert len(m) == 133


def test_truth_list_trivia(spark):
    df = spark.createDataFrame([("v", "a; b ;;")], "ground_truth_value string, ground_truth_aliases string")
    assert df.select(truth.truth_list("triviaqa", df).alias("t")).first().t == ["v", "a", "b"]


def test_counts_give_the_same_caption_columns(spark):
    from tracewise.operators import truth
    features = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "image_filename string")
    ann = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("c", 1, "z"), ("unmatched", 1, "p"), ("unmatched", 2, "q"), ("unmatched", 3, "r")], "file_name string, pos int, caption string")
    captions, counts = truth.captions_list(ann, ["pos"]), ann.groupBy("file_name").count().withColumnRenamed("count", "n")
    want, got = truth.captions_wide(features, captions), truth.captions_wide(features, captions, counts=counts)
    assert got.columns == want.columns == ["image_filename", "ground_truth_1", "ground_truth_2"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

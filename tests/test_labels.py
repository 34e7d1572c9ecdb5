from pyspark.sql import functions as F

from tracewise.functions.similarity import ratios, similarity
from tracewise.operators import labelling, matching, tagger


def test_similarity_direction(spark):
    assert ratios(["tide", "diet"], ["diet", "tide"]).tolist() == [0.25, 0.5]
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r.r for r in df.select(similarity(F.col("a"), F.col("b")).alias("r")).collect()] == [0.25, 0.5]


def test_tagger_heads(spark):
    g = spark.createDataFrame([(1, "A red bolt on a blue ring.")], "sample_id long, t string")
    toks = {r.text: r for r in tagger.tag(g, ["sample_id"], "t").collect()}
    assert toks["red"].head_idx == toks["bolt"].tok_idx
    assert toks["bolt"].head_idx == toks["on"].tok_idx and toks["ring"].head_idx == toks["on"].tok_idx
    assert toks["on"].dep == "prep" and toks["ring"].char_start == 21


def _label(spark, gen, refs):
    g = spark.createDataFrame(gen, "sample_id long, generated_description string")
    r = spark.createDataFrame(refs, "sample_id long, gt_idx int, gt_text string")
    return labelling.label(labelling.prepare(g, r))


def test_hierarchical_labels(spark):
    lab = _label(spark, [(1, "A red bolt on a blue ring. The small gear holding the widget.")],
                 [(1, 0, "A red bolt on a old ring."), (1, 1, "The gear near the rod.")])
    got = {(r.chunk_type, r.chunk_text): r.chunk_label for r in lab.collect()}
    assert got[("object", "bolt")] == "CORRECT"
    assert got[("object", "widget")] == "CATEGORY_HALLUC"
    assert got[("attribute", "red bolt")] == "CORRECT"
    assert got[("attribute", "blue ring")] == "ATTRIBUTE_HALLUC"     # known colour not in truth
    assert got[("relation", "bolt on ring")] == "CORRECT"
    assert got[("relation", "gear holding widget")] == "CATEGORY_HALLUC"
    assert [r.chunk_idx for r in lab.orderBy("start", "chunk_idx").collect()] == list(range(lab.count()))


def test_default_chunk_and_relation_substring(spark):
    lab = _label(spark, [(2, "Nothing here at all")], [(2, 0, "a person")])
    r = lab.collect()
    assert len(r) == 1 and r[0].chunk_type == "object" and r[0].start == 0 and r[0].end == 19
    refs = spark.createDataFrame([(2, 0, "a person")], "sample_id long, gt_idx int, gt_text string")
    assert "on" in {x.rel for x in matching.truth_relations(refs).collect()}


def test_object_cascade_stages(spark):
    terms = spark.createDataFrame([(1, t) for t in ["Scene", "puppy", "sailboats", "wine", "gizmu", "zzz"]],
                                  "sample_id long, term string")
    gt = spark.createDataFrame([(1, "dog"), (1, "boat"), (1, "sail"), (1, "gizmo")], "sample_id long, obj string")
    ex = {r.term: r.exists for r in matching.object_exists(terms, gt).collect()}
    assert ex == {"Scene": True, "puppy": True, "sailboats": True, "wine": False, "gizmu": True, "zzz": False}
    ex0 = {r.term: r.exists for r in matching.object_exists(terms, gt, fuzzy=False).collect()}
    assert ex0["gizmu"] is False


def test_label_plan_has_no_cartesian(spark):
    lab = _label(spark, [(1, "A red bolt on a blue ring.")], [(1, 0, "A red bolt.")])
    plan = lab._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_sample_long_text(spark):
    # one sample with a very long text next to ordinary ones
    long_text = " ".join(["A red bolt on a blue ring."] * 400 + ["The small gear holding the widget."] * 300)
    gen = [(1, long_text)] + [(i, "A red bolt on a blue ring.") for i in range(2, 40)]
    refs = [(1, 0, "A red bolt on a old ring."), (1, 1, "The gear near the rod.")] + \
           [(i, 0, "A red bolt.") for i in range(2, 40)]
    lab = _label(spark, gen, refs)
    hot = lab.filter("sample_id = 1")
    # duplicates collapse to the first mention: each distinct chunk once
    got = {(r.chunk_type, r.chunk_text): r.chunk_label for r in hot.collect()}
    assert got[("attribute", "blue ring")] == "ATTRIBUTE_HALLUC" and got[("object", "widget")] == "CATEGORY_HALLUC"
    assert sorted(r.chunk_idx for r in hot.collect()) == list(range(hot.count()))
    assert lab.filter("sample_id = 5 AND chunk_text = 'ring'").first().chunk_label == "CATEGORY_HALLUC"


TEXTS = [(1, "A red bolt on a blue ring. The small gear holding the widget."), (2, "  Nothing! "), (3, "a a. x"), (4, "Dogs chasing balls near 3 trees? Red dogs, red DOGS"),
         (5, "éclair on the naïve café_x　beside ünder it"), (None, "A red bolt on a ring."), (6, "."), (7, "")]


def test_arrays_hold_what_the_token_table_gives(spark):
    """The chunks made in the row equal those of the general form over the token table; nothing is shuffled for them."""
    g = spark.createDataFrame(TEXTS, "sample_id long, generated_description string")
    side = labelling.prepare_generated(g)
    general = labelling.prepare_generated(g, tag=lambda *a: tagger.tag(*a))
    cols = ["sample_id", "chunk_idx", "chunk_text", "chunk_type", "start", "end", "attribute", "object", "relation", "objects"]
    rows = lambda df: sorted(map(str, df.select(*cols).filter("sample_id IS NOT NULL").collect()))
    assert rows(side.chunks) == rows(general.chunks) and len(rows(side.chunks)) > 10
    plan = side.chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert "Exchange" not in tagger.tag(g, ["sample_id"], "generated_description")._jdf.queryExecution().executedPlan().toString()


def test_labels_shuffle_texts_alone(spark):
    """Both sides meet once by sample; no term, token or chunk is shuffled and nothing is written in between."""
    refs = spark.createDataFrame([(1, 0, "A red bolt on a old ring."), (1, 1, "The gear near the rod.")], "sample_id long, gt_idx int, gt_text string")
    lab = labelling.label(labelling.prepare(spark.createDataFrame(TEXTS, "sample_id long, generated_description string"), refs))
    plan = lab._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "Scan ExistingRDD[chunk" not in plan
    none = lab.filter("sample_id IS NULL").collect()
    assert [r.chunk_label for r in none] == ["CATEGORY_HALLUC"] * len(none) and none


def test_batch_ratio_equals_pairs(spark):
    from difflib import SequenceMatcher

    from tracewise.operators.fuzzy import any_similar
    asked, given = ["gizmu", "zzz", "", "window", "Éa"], ["gizmo", "windows", "", "éa"]
    df = spark.createDataFrame([(asked, given), ([], given), (asked, []), (["rod"], ["rods"])], "a array<string>, b array<string>")
    for t in (0.5, 0.7, 0.8, 1.0):
        got = [r.x for r in df.select(any_similar(t)("a", "b").alias("x")).collect()]
        want = [[any(a and b and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= t for b in r.b) for a in r.a] for r in df.collect()]
        assert got == want


def test_texts_of_chosen_orders_only(spark):
    from tracewise.sources import fixtures
    sf = "/root/testdata/sf0.001"
    every = {r.sample_id: r.generated_description for r in fixtures.generations(spark, sf).collect()}
    ids = sorted(every)[:3]
    only = spark.createDataFrame([(i,) for i in ids], "sample_id long")
    assert {r.sample_id: r.generated_description for r in fixtures.generations(spark, sf, only).collect()} == {i: every[i] for i in ids}
    assert {r.sample_id for r in fixtures.references(spark, sf, only).collect()} <= set(ids)


def test_weights_of_counts(spark):
    from tracewise.operators import report
    d = spark.createDataFrame([("a",)] * 90 + [("b",)] * 7 + [("c",)] * 3, "label string")
    n = d.groupBy("label").count().withColumnRenamed("count", "n")
    assert sorted(map(tuple, report.weights_of_counts(n, "label").collect())) == sorted(map(tuple, report.class_weights(d, "label").collect()))

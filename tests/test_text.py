import pytest
from pyspark.sql import functions as F

from tracewise.functions import text
from tracewise.operators import samples


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("v")).first().v


def test_repetition(spark):
    sch = "t array<int>"
    rep, brep, ur = text.repetition_features(F.col("t"))
    assert one(spark, rep, [1, 2, 1, 2], sch) == pytest.approx(0.5)
    assert one(spark, brep, [1, 2, 1, 2], sch) == pytest.approx(1 - 2 / 3)
    assert one(spark, ur, [1, 2, 1, 2], sch) == pytest.approx(0.5)
    assert [one(spark, e, [7], sch) for e in (rep, brep, ur)] == [0.0, 0.0, 1.0]
    assert [one(spark, e, [], sch) for e in (rep, brep, ur)] == [0.0, 0.0, 0.0]


def test_text_repetition_is_that_of_its_words(spark):
    """texts are split and counted in one pass, with the results of the array form."""
    odd = ["a b a b", "x", "", None, " \t\n", "a\u00a0b\u3000a\x1cb\x85 a  b", "İ i̇ 😀 😀\x00 😀", "ab c a bc ab c", "1:ab 1:ab"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    out = text.with_repetition(df, "t", ("rep", "brep", "ur"))
    slow = text.repetition_features(text.words(F.col("t")))
    want = df.select("i", "t", *[c.alias(n) for c, n in zip(slow, ("rep", "brep", "ur"))])
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out.select("rep")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "_bigram_count" not in plan  # who asks for words alone pays for no bigrams


def test_words_are_python_split(spark):
    s = "a b  c\td　e\n"
    assert one(spark, text.words(F.col("t")), s) == s.split()
    assert one(spark, text.truncate_words(F.col("t"), 3), s) == " ".join(s.split()[:3])


def test_normalize_unicode(spark):
    import re
    s = "  Ünïcode, über-Straße!  ½ "
    assert one(spark, text.normalize(F.col("t")), s) == re.sub(r"[^\w\s]", "", s.lower()).strip()


def test_sanitize(spark):
    assert one(spark, text.sanitize_lines(F.col("t"), True), " a\nb\r ") == "a b"


def test_aliases(spark):
    assert one(spark, text.split_aliases(F.col("t")), "x; y ;; z ") == ["x", "y", "z"]


def test_dialogue_period_rule(spark):
    conv = spark.createDataFrame([
        (1, 0, "system", "Story."), (1, 1, "user", "q1"), (1, 2, "assistant", "a1."),
        (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (1, 5, "user", "q3"), (1, 6, "assistant", "a3")],
        "conv_id long, turn long, role string, text string")
    d = {r.q_idx: r.story for r in samples.dialogue_pairs(conv).collect()}
    assert d[0] == "Story."
    assert d[1] == "Story. Q: q1 A: a1."
    assert d[2] == "Story. Q: q1 A: a1. Q: q2 A: a2."


def test_prompt_templates(spark):
    df = spark.createDataFrame([("tydiqa", "Q?", "C"), ("unknown", "Q?", "C")],
                               "dataset string, question string, context string")
    out = [r.p for r in df.select(samples.prompt(F.col("dataset"), set(df.columns)).alias("p")).collect()]
    assert out == ["Answer the question concisely based on the context: \n C \n Q: Q? A:", "Q?"]


def test_first_per_key_and_names(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "pos long, k string, v string")
    got = {r.k: r.v for r in samples.first_per_key(df, "k", "pos").collect()}
    assert got == {"a": "y", "b": "z"}
    n = samples.name_samples(df, "coqa", ["pos"]).orderBy("pos").collect()
    assert [r.name for r in n] == ["coqa_sample_0", "coqa_sample_1", "coqa_sample_2"]


def test_virtual_catalog_keeps_gaps(spark):
    df = spark.createDataFrame([(0, ["i0"]), (1, []), (2, ["i2", "j"])], "idx long, images array<string>")
    assert [r.name for r in samples.virtual_catalog(df).orderBy("name").collect()] == ["llava_image_0", "llava_image_2"]


def test_image_catalog(spark, scratch):
    import os
    for n in ("a.JPG", "b.png", "c.txt"):
        open(os.path.join(scratch, n), "wb").write(b"x")
    got = sorted(r.filename for r in samples.image_catalog(spark, scratch).collect())
    assert got == ["a.JPG", "b.png"]


def test_coqa_json(spark, scratch):
    import json
    import os
    data = {"data": [{"id": "s1", "story": "S.", "questions": [{"input_text": "q0"}, {"input_text": "q1"}],
                      "answers": [{"input_text": "a0", "span_start": 1}, {"input_text": "a1.", "span_start": 2}],
                      "additional_answers": {"0": [{"input_text": "x"}, {"input_text": "y"}],
                                             "1": [{"input_text": "x"}, {"input_text": "y"}],
                                             "2": [{"input_text": "x"}, {"input_text": "y"}]}}]}
    p = os.path.join(scratch, "coqa.json")
    open(p, "w").write(json.dumps(data))
    rows = {r.id: r for r in samples.coqa_from_json(spark, p).collect()}
    assert rows["s1_0"].story == "S."
    assert rows["s1_1"].story == "S. Q: q0 A: a0."
    assert rows["s1_1"].additional_answers == ["y", "y", "y"]


def test_load_qa_dataset_rules(spark, scratch):
    import os
    trivia = spark.createDataFrame([("q1", "a?"), ("q1", "dup?"), ("q2", "b?"), ("q3", "c?")],
                                   "question_id string, question string")
    tp = os.path.join(scratch, "trivia")
    trivia.coalesce(1).write.parquet(tp)
    got = samples.load_qa_dataset(spark, "triviaqa", tp, max_samples=2).orderBy("idx").collect()
    assert [(r.name, r.question) for r in got] == [("triviaqa_sample_0", "a?"), ("triviaqa_sample_1", "b?")]
    tydi = spark.createDataFrame([("english-1", "x"), ("french-2", "y"), ("english-3", "z")], "id string, question string")
    yp = os.path.join(scratch, "tydi")
    tydi.coalesce(1).write.parquet(yp)
    got = samples.load_qa_dataset(spark, "tydiqa", yp).orderBy("idx").collect()
    assert [(r.name, r.id) for r in got] == [("tydiqa_sample_0", "english-1"), ("tydiqa_sample_1", "english-3")]
    with pytest.raises(ValueError):
        samples.load_qa_dataset(spark, "nope", yp)


def test_apply_per_item_hook(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string").repartition(3)

    def fn(pdf):
        return pdf.assign(n=pdf["text"].str.len())[["id", "n"]]
    out = samples.apply_per_item(df, fn, "id long, n long")
    assert sorted((r.id, r.n) for r in out.collect()) == [(i, len(f"t{i}")) for i in range(20)]

"""Labels worked out in batches: the rules of the token table, no text shuffled twice."""

from tracewise.operators import chunks, labelling, matching, tagger
from tracewise.plans import learn_queries
from tracewise.sources import fixtures

SF = "/root/testdata/sf0.001"
TEXTS = ["A red ring on a blue plate. The old dogs holding the leaves!", "  ", "the of and", "Ring RING ring  ring's\tring\n　A_b 3rd ١ x².",
         "Women walking beside shiny boxes under wolves, Cafés Über naïve 人 😀 İstanbul", "A gizmo near a rod near a rod? an", "quickly", ""]
REFERENCES = ["A red rings on a widget.", "Large dog wearing a RED bottle next to the boxes.", "", "café in front of man", "a A İstanbul wooden: wooden"]


def _rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def _sides(spark):
    g = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (99, None), (100, TEXTS[4])], "sample_id long, generated_description string")
    r = spark.createDataFrame([(i, k, t) for i in range(len(TEXTS)) for k, t in enumerate(REFERENCES[: i % 6])] + [(None, 0, REFERENCES[0]), (99, 0, "a ring"), (0, 1, None)],
                              "sample_id long, gt_idx int, gt_text string")
    return g, r


def test_batches_follow_the_rules_of_the_token_table(spark):
    g, r = _sides(spark)
    table = lambda *a: tagger.tag(*a)  # noqa: E731  any tagger but the default one goes through tables
    for fuzzy in (False, True):
        mine, theirs = (labelling.explained(labelling.prepare(g.filter("sample_id IS NOT NULL"), r, tag=t), fuzzy) for t in (tagger.tag, table))
        assert _rows(mine) == _rows(theirs)
    r = r.filter("sample_id IS NOT NULL")
    assert _rows(labelling.prepare_references(r)) == _rows(labelling.prepare_references(r, tag=table))


def test_without_an_id_only_objects_are_found(spark):
    g, _ = _sides(spark)
    rows = chunks.chunk_rows(chunks.with_chunks(g.filter("sample_id IS NULL"))).collect()
    assert rows and {x.chunk_type for x in rows} == {"object"}


def test_long_texts_are_cut_into_runs():
    import pyarrow as pa
    assert list(tagger.runs(pa.array([3, 3, None, 9, 1]), 6)) == [(0, 3), (3, 4), (4, 5)]
    assert list(tagger.runs(pa.array([], pa.int32()))) == []


def test_texts_are_shuffled_by_order_alone(spark):
    li = labelling.prepare(fixtures.generations(spark, SF), fixtures.references(spark, SF))
    plan = labelling.label(li, fuzzy=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey") == 2  # once each side
    assert "hashpartitioning(sample_id" not in plan


def test_summary_joins_a_row_per_sample(spark):
    plan = learn_queries.run_summary(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # chunks become rows above the join


def test_labels_in_one_pass_are_those_of_the_steps(spark):
    """texts become labelled chunks in one Python step, with the rows of the three steps."""
    g, r = _sides(spark)
    for fuzzy in (False, True):
        li = labelling.prepare(g, r)
        steps = chunks.chunk_rows(matching.with_labels(li.samples, fuzzy))
        whole = labelling.label(li, fuzzy)
        assert whole.columns == steps.columns and _rows(whole) == _rows(steps)
        assert _rows(labelling.label(li, fuzzy, ("chunk_text", "chunk_label"))) == _rows(steps.select("sample_id", "chunk_idx", "chunk_text", "chunk_label"))
    plan = labelling.label(labelling.prepare(g, r), fuzzy=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

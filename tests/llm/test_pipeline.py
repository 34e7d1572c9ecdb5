import corpus_pipeline
from helpers import PASSAGE, awkward, documents, empty

from tracewise.llm import queries
from tracewise.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    clean = [(i, f"Note {i}: " + " ".join(f"{w}{i}" for w in PASSAGE.split())) for i in range(20)]
    from tracewise.sources.tables import table
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    texts = clean + [(100, clean[3][1]), (101, None), (102, "123 456"), (103, item + " and a few words of its own"),
                     (104, "First page has this. " + PASSAGE), (105, "Quite another opening. " + PASSAGE + " Entirely different ending of many more words than before, "
                                                                  + " ".join(f"extra{k}" for k in range(200)))]
    docs = documents(spark, texts)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {*range(20), 104, 105}
    assert PASSAGE in left[104].text and "harbour" not in left[105].text and left[105].n_chars == len(left[105].text)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == 22 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_take_awkward_and_empty_tables(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))

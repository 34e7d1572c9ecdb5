import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tracewise.operators import fuzzy, labelling, matching

WORDS = """person people child children bicycle bicycles motorcycle motor window windows table tables tablecloth plate plates
streetlight street light traffic sign signal dog doghouse cat cattle cow sheep ship shop umbrella boat sailboat sail water waterfall
bottle battle glass glasses grass building build bench beach bus busstop truck trunk tree trees three chair hair stair stairs""".split()


def pairs_of(spark, left, right):
    return (spark.createDataFrame(left, "k long, a string"), spark.createDataFrame(right, "k long, b string"))


@pytest.fixture(scope="module")
def sides():
    rnd = random.Random(7)
    noise = lambda: "".join(rnd.choices("abcde é日", k=rnd.randrange(0, 9)))
    left = [(k, rnd.choice(WORDS)) for k in range(12) for _ in range(15)] + [(k, noise()) for k in range(12) for _ in range(10)] + [(1, None), (None, "dog"), (1, "")]
    right = [(k, rnd.choice(WORDS)) for k in range(12) for _ in range(15)] + [(k, noise()) for k in range(12) for _ in range(10)] + [(1, None), (None, "dog"), (1, "")]
    return left, right


def every_pair(left, right):
    return {(k, a, b) for k, a in left for j, b in right if k == j and k is not None and a and b}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 1.0])
def test_similar_pairs_lose_nothing(spark, sides, threshold):
    lf, rt = pairs_of(spark, *sides)
    got = {(r.k, r.a, r.b): r.ratio for r in fuzzy.similar_pairs(lf, rt, ["k"], "a", "b", threshold).collect()}
    want = {p: SequenceMatcher(None, p[1], p[2]).ratio() for p in every_pair(*sides)}
    assert got == {p: r for p, r in want.items() if r >= threshold}


def test_few_pairs_are_compared(spark, sides, monkeypatch):
    lf, rt = pairs_of(spark, [x for x in sides[0] if x[1] in WORDS], [x for x in sides[1] if x[1] in WORDS])
    words = {(a, b) for _, a, b in every_pair(*sides) if a in WORDS and b in WORDS}
    vocabulary = fuzzy.profiles(lf.unionByName(rt.withColumnRenamed("b", "a")), "a", 0.7)
    pairs = fuzzy.candidate_pairs(lf, rt, ["k"], "a", "b", vocabulary)
    assert pairs.count() == pairs.distinct().count()
    monkeypatch.setattr(fuzzy, "similarity", lambda a, b: F.lit(1.0))
    compared = fuzzy.scored_pairs(pairs, "a", "b", vocabulary, 0.7).count()
    assert len(words) > 1000 and compared * 10 <= len(words)


def test_contained_pairs_equal_brute_force(spark, sides):
    lf, rt = pairs_of(spark, *sides)
    got = {(r.k, r.a, r.b) for r in fuzzy.contained_pairs(lf, rt, ["k"], "a", "b").collect()}
    assert got == {(k, a, b) for k, a, b in every_pair(*sides) if len(a) > 3 and a in b}


def test_long_words_cost_linear_work(spark):
    """One word of 10,000 characters in a sample: 9,997 grams, where all its substrings would be 5 * 10^7."""
    rnd = random.Random(1)
    junk = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=10_000))
    terms = spark.createDataFrame([(1, junk), (1, "zzzyq"), (1, junk[5000:5100]), (2, "plain")], "sample_id long, term string")
    objs = spark.createDataFrame([(1, junk[:9000]), (1, junk[4900:5300]), (1, "object"), (2, junk)], "sample_id long, obj string")
    t0 = time.time()
    got = {r.term: r.exists for r in matching.object_exists(terms, objs).collect()}
    assert got == {junk: True, "zzzyq": False, junk[5000:5100]: True, "plain": False}
    assert time.time() - t0 < 60
    assert fuzzy.contained_pairs(objs, terms, ["sample_id"], "obj", "term").count() == 2


def test_reasons_name_what_is_missing(spark):
    g = spark.createDataFrame([(1, "A red bolt on a blue ring. The small gear holding the widget.")], "sample_id long, generated_description string")
    r = spark.createDataFrame([(1, 0, "A red bolt on a old ring."), (1, 1, "The gear near the rod.")], "sample_id long, gt_idx int, gt_text string")
    li = labelling.prepare(g, r)
    lab = labelling.label(li)
    why = {x.chunk_text: x.reasoning for x in matching.label_explanations(lab, li.gt_objects, li.gt_attributes, li.gt_relations).collect()}
    assert why["gear holding widget"] == "Not among the reference objects: widget; reference objects: bolt, gear, ring, rod"
    assert why["blue ring"].startswith("Object 'ring' exists; attribute 'blue' is incorrect; reference attributes: ") and "colors:red" in why["blue ring"]
    assert why["bolt on ring"] == "Objects exist: bolt, ring; relation 'on' is correct" and why["bolt"] == "Object 'bolt' is among the reference objects"
    assert [x.missing_objects for x in lab.filter("chunk_text = 'gear holding widget'").collect()] == [["widget"]]
    assert lab.filter(F.col("object_ok") & (F.size("missing_objects") > 0)).count() == 0

import random
from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewise.functions.similarity import ratios, similarity

word = st.text(alphabet="abcé日 ", max_size=14)
long = st.text(alphabet="abcdefghij", min_size=150, max_size=420)


def wanted(pairs):
    return [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(word, word), max_size=12))
def test_ratios_equal_the_definition(pairs):
    assert ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == wanted(pairs)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(long, long), min_size=1, max_size=3))
def test_common_characters_of_long_strings_start_no_block(pairs):
    assert ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == wanted(pairs)


def test_mixed_batch_with_long_strings():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choices("etaoinshrdlu ", k=n))
    pairs = [(text(rnd.randrange(0, 40)), text(rnd.randrange(0, 40))) for _ in range(300)] + [(text(900), text(1000)), (text(5), text(3000)), ("x" * 10_000, "x" * 199)]
    base = text(600)
    pairs += [(base[:300] + "ZZ" + base[300:], base), ("", ""), ("", "a"), ("a", "")]
    assert np.array_equal(ratios([a for a, _ in pairs], [b for _, b in pairs]), wanted(pairs))


def test_column_form(spark):
    df = spark.createDataFrame([("Tide", "diet"), (None, "a"), ("", ""), ("a", None)], "a string, b string")
    assert [r.r for r in df.select(similarity(F.col("a"), F.col("b")).alias("r")).collect()] == [0.25, None, 1.0, None]

import hashlib
import re
from collections import defaultdict

import numpy as np
from helpers import awkward, documents, empty

from tracewise.llm import decontamination as D
from tracewise.sources.tables import table

SF = "/root/testdata/sf0.001"


def brute(docs, items, window=13):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k:k + window])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_words_of_every_character():
    for c in [*range(0xD800), 0xE000, 0xFEFF, 0x1F600]:
        text = f"A{chr(c)}b{chr(c)}{chr(c)}Z"
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)
        assert [w.decode() for w in D.words(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(D.contamination(docs, items)) == sorted(want, key=repr)


def test_short_items_repeats_and_ties(spark):
    texts = [(1, "a b a b a b c"), (2, "A, b! a; B"), (3, "b"), (4, None), (5, "é9 zz")]
    items = spark.createDataFrame([(1, "a b"), (2, "b a b"), (None, "é9"), (3, "!!"), (4, None), (1, "a b")], "item_id long, text string")
    got = rows(D.contamination(documents(spark, texts), items))
    assert got == sorted(brute(texts, [(1, "a b"), (2, "b a b"), (None, "é9"), (3, "!!"), (4, None)]), key=repr)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = rows(D.contamination(docs, items))
    monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", 2000)
    assert rows(D.contamination(docs, items)) == want


def test_proximity(spark):
    docs = documents(spark, [(1, "red x fox y jumps"), (2, "red " + "z " * 30 + "fox jumps"), (3, "red fox jumps")])
    items = spark.createDataFrame([(7, "red fox jumps")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in D.contamination(docs, items, slop=5).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (1, 1)}


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "plain text of a few words")], "item_id long, text string")
    got = rows(D.contamination(awkward(spark), items))
    assert len(got) == 12  # the row that repeats id and text is one document
    assert [r for r in got if r[0] == 1][0][2:4] == (6, 1) and [r for r in got if r[0] == 2][0][1] == 0
    kept = D.without_contaminated(awkward(spark), items)
    assert kept.columns == awkward(spark).columns and kept.count() == 12
    assert D.contamination(empty(spark), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in D.contamination(awkward(spark), none).collect())


def test_many_rows_equal_in_id_and_text_are_one_document(spark):
    docs = documents(spark, [(None, "red fox jumps high")] * 300 + [(None, None)] * 300 + [(4, "red fox")])
    items = spark.createDataFrame([(7, "fox jumps"), (8, "red fox")], "item_id long, text string")
    got = rows(D.contamination(docs, items))
    assert got == sorted(brute([(None, "red fox jumps high"), (None, None), (4, "red fox")], [(7, "fox jumps"), (8, "red fox")]), key=repr)


def test_window_wider_than_the_slop(spark):
    phrase = " ".join(f"w{k}" for k in range(30))
    docs = documents(spark, [(1, f"before {phrase} after"), (2, phrase.replace("w29", "other")), (3, "w1 " * 5)])
    items = spark.createDataFrame([("a", phrase)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.contamination(docs, items, window=30, slop=16).collect()}
    assert got == {1: (30, 1), 2: (0, 0), 3: (0, 0)}


def test_many_phrases_stay_small():
    """A block's phrases are arrays: a few dozen bytes each, whatever the items hold."""
    import pickle
    import random
    rnd = random.Random(2)
    items = [(f"i{k}", " ".join(f"w{rnd.randrange(20_000)}" for _ in range(2_000))) for k in range(50)] + [("short", "w1 w2"), ("none", "..."), ("twin", "w1 w2")]
    p = D.Phrases(items, 13)
    assert len(p.terms) > 90_000 and len(pickle.dumps([p.terms, p.item, p.item_end])) < 100 * len(p.terms)
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, len(p.vocabulary))
    p.order_by_rarity(counts)
    for i in (0, 5, len(p.terms) - 1):
        plan = p.plan(i)
        assert [counts[t] for t, _ in plan] == sorted(counts[t] for t, _ in plan) and len({k for _, k in plan}) == len(plan)
    short = next(i for i in range(len(p.terms)) if len(p.plan(i)) == 2)
    assert p.items(short) == ["short", "twin"]
    some = np.unique(np.concatenate([[t for t, _ in p.plan(i)] for i in (3, 7, short)]))
    want = [i for i in range(len(p.terms)) if set(t for t, _ in p.plan(i)) <= set(some.tolist())]
    assert sorted(p.possible(some).tolist()) == want and {3, 7, short} <= set(want)

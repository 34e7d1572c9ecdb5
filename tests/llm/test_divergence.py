import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, empty, multiset
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewise.llm import divergence
from tracewise.llm.transducer import Transducer, Vocabulary, build

COLS = ["lang", "source", "part", "item", "value", "rank"]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=60))
def test_transducer_is_minimal_and_numbers_terms(terms):
    terms = sorted(terms)
    t = Transducer.from_bytes(build(terms).to_bytes())
    suffixes = {frozenset(x[len(p):] for x in terms if x.startswith(p)) for w in terms for p in (w[:i] for i in range(len(w) + 1))}
    assert len(t.final) == len(suffixes)
    v = Vocabulary([("x", 5, len(terms), terms[0], t.to_bytes())])
    assert v.ordinals("x", terms).tolist() == list(range(5, 5 + len(terms)))
    assert [v.term("x", 5 + i) for i in range(len(terms))] == terms
    others = [w + b"a" for w in terms] + [b"zz\xff", b""]
    assert v.ordinals("x", others).tolist() == [5 + terms.index(w) if w in terms else -1 for w in others]
    assert v.term("x", 4) is None and v.term("x", 5 + len(terms)) is None and v.ordinals("y", terms).tolist() == [-1] * len(terms)


def test_transducer_wants_ascending_terms():
    for bad in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError):
            build(bad)


def brute(rows, least):
    """Every group against every term, in Python integers."""
    rows = [(t or "", la or "", s or "") for _, t, la, s, *_ in rows]
    word = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    out = []
    for lang in {la for _, la, _ in rows}:
        mine = [(word(t), s) for t, la, s in rows if la == lang]
        df = Counter(w for ws, _ in mine for w in set(ws))
        kept = sorted((w for w, n in df.items() if n >= least), key=str.encode)
        def p(count, total):
            return [1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept]
        n = {s: Counter(w for ws, x in mine if x == s for w in ws if w in set(kept)) for _, s in mine}
        rate = {s: p(c, sum(c.values())) for s, c in n.items()}
        whole = sum(n.values(), Counter())
        q = p(whole, sum(whole.values()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = [(sum(map(f, rate[s], rate[o])), o) for o in n if o != s]
            terms = [(f(a, b), w) for w, a, b in zip(kept, rate[s], q) if n[s][w] and a > b]
            for part, items, limit in (("pair", pairs, None), ("term", terms, 10)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, v, i + 1) for i, (v, w) in enumerate(items[:limit])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, options", [(1, {}), (2, {"shard_terms": 3, "block_bytes": 1, "tile": 2}), (99, {})])
def test_awkward_rows_equal_brute_force(spark, least, options):
    more = [(i, f"Größe {'alpha ' * (i % 5)} beta{'x' * (i % 3)} 日本 tie{i % 2}", ["en", "fr", None][i % 3], [None, "", "a", "b", "c"][i % 5]) for i in range(100, 160)]
    docs = awkward(spark).unionByName(documents(spark, more), allowMissingColumns=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert multiset(divergence.source_divergence(docs.repartition(5), least, **options), *COLS) == brute(rows, least)


def test_empty_tables(spark):
    assert divergence.source_divergence(empty(spark)).collect() == []


def test_rates_stay_exact_for_large_counts():
    n, total = np.array([0, 5, 1 << 60]), np.array([7, 7, (1 << 60) + 9])
    assert divergence.rates(n, total).tolist() == [1 + 10**9 * (a + 2) // b for a, b in zip(n.tolist(), total.tolist())]
    assert divergence.rates(n[:2], total[:2]).tolist() == [1 + 10**9 * 2 // 7, 1 + 10**9]

"""Full labels (fuzzy stage included) against a brute-force Python restatement.

Inputs are the sf0.001 fixture texts; tokens and chunks come from Spark (both
are checked against DuckDB elsewhere).  Reference sets and every rule are
recomputed here pair by pair with difflib.
"""

import re
from collections import defaultdict
from difflib import SequenceMatcher

from tracewise.functions.lexicons import (GENERIC_WORDS, RELATIONS, attribute_category_map, synonym_map)
from tracewise.operators import labelling, tagger
from tracewise.sources import fixtures

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_labels_match_bruteforce(spark):
    gen = fixtures.generations(spark, SF)
    refs = fixtures.references(spark, SF)
    li = labelling.prepare(gen, refs)
    spark_labels = {(r.sample_id, r.chunk_idx): r.chunk_label for r in labelling.label(li, fuzzy=True).collect()}
    chunks = li.chunks.collect()
    ref_rows = refs.collect()
    gt_tok = tagger.tag(refs, ["sample_id", "gt_idx"], "gt_text").collect()

    syn, acat = synonym_map(), attribute_category_map()
    canon = lambda w: syn.get(w, w)
    objs, attrs, rels = defaultdict(set), defaultdict(dict), defaultdict(set)
    for t in gt_tok:
        if t.pos in ("NOUN", "PROPN") and not t.is_stop:
            objs[t.sample_id].add(t.lemma.lower())
        if t.pos == "ADJ" and not t.is_stop:
            w = t.lemma.lower()
            attrs[t.sample_id].setdefault(acat.get(w, "other"), set()).add(w)
    for r in ref_rows:
        low = r.gt_text.lower()
        for w in low.split():
            if w in acat:
                attrs[r.sample_id].setdefault(acat[w], set()).add(w)
        for rel in RELATIONS:
            if rel in low:
                rels[r.sample_id].add(rel)

    def exists(term, sid):
        ol = term.lower().strip()
        if ol in GENERIC_WORDS or ol in objs[sid]:
            return True
        for g in objs[sid]:
            if canon(ol) == canon(g) or (len(ol) > 3 and len(g) > 3 and (ol in g or g in ol)):
                return True
        for w in re.findall(r"\w+", ol):
            if any(canon(w) == canon(g) for g in objs[sid]):
                return True
        return any(ratio(ol, g) >= 0.7 for g in objs[sid])

    def attr_ok(attr, sid):
        al = attr.lower().strip()
        a = attrs[sid]
        for words in a.values():
            if al in words or any(ratio(al, g) >= 0.8 for g in words):
                return True
        if al in acat:
            return False
        if a.get("other"):
            return any(ratio(al, g) >= 0.7 for g in a["other"])
        return not any(a.values())

    def rel_ok(rel, sid):
        rl = rel.lower()
        return rl in rels[sid] or any(ratio(rl, g) >= 0.7 for g in rels[sid])

    mismatches = []
    for c in chunks:
        sid = c.sample_id
        if c.chunk_type == "object":
            want = "CORRECT" if exists(c.chunk_text, sid) else "CATEGORY_HALLUC"
        elif c.chunk_type == "attribute":
            want = ("CATEGORY_HALLUC" if not exists(c.object, sid)
                    else "CORRECT" if attr_ok(c.attribute, sid) else "ATTRIBUTE_HALLUC")
        else:
            want = ("CATEGORY_HALLUC" if not all(exists(o, sid) for o in c.objects)
                    else "CORRECT" if rel_ok(c.relation, sid) else "RELATION_HALLUC")
        if spark_labels[(sid, c.chunk_idx)] != want:
            mismatches.append((sid, c.chunk_idx, c.chunk_text, spark_labels[(sid, c.chunk_idx)], want))
    assert len(chunks) > 1000 and not mismatches, mismatches[:5]

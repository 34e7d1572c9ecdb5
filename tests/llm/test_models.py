import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import PASSAGE, awkward, documents, empty

from tracewise.llm import language_id, language_model, quality
from tracewise.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    docs = table(spark, SF, "documents")
    label = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == label[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_profile_is_the_sum_of_bound_trigrams():
    text = "Ab, ab é"
    seq = ["\0", "a", "b", "\0", "a", "b", "\0", "é", "\0"]
    vec = lambda c: language_id.letter_vector(0 if c == "\0" else ord(c), 64).astype(int)
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(seq, seq[1:], seq[2:]))
    got = language_id.profiles(["", text, "12"], 64)
    assert np.array_equal(got[1], want) and not got[0].any() and not got[2].any()


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    p = language_id.train(docs)
    assert set(p) == {"en", "de", "xx"}
    rows = language_id.predict(docs, p).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, 8}
    kept = language_id.keep_identified(docs, p)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}


def test_base_scores_and_probabilities(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", low(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in language_model.scored_documents(docs).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_model_is_a_distribution_and_beats_the_base(spark):
    docs = table(spark, SF, "documents")
    held = language_model.id_remainder("doc_id", 7) == 2
    scores, t = language_model.language_model(docs, docs.filter(~held))
    p = 10.0 ** t.class_log.astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    w = 10.0 ** t.word_log.astype(float)
    for i in range(0, t.shape.words, t.shape.class_words):
        assert np.allclose(w[:, i:i + t.shape.class_words].sum(axis=1), 1, atol=1e-4)
    by_rank = t.counts[np.argsort(t.rank)]
    assert t.rest_total >= by_rank[t.shape.words:].sum() and 0 < t.discount < 1
    s = scores.filter(held).agg({"score": "sum", "base_score": "sum"}).first()
    assert s["sum(score)"] > s["sum(base_score)"]


def test_small_head_joins_the_rest(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = lambda: {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in language_model.language_model(docs, docs)[0].collect()}
    want = rows()
    monkeypatch.setattr(language_model, "HEAD_TOKENS", 700)
    assert rows() == want


def test_model_awkward_rows(spark):
    docs = awkward(spark)
    rows = language_model.scored_documents(docs).collect()
    assert len(rows) == docs.count() and [r.n_tokens for r in rows if r.doc_id == 2] == [1]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert language_model.scored_documents(empty(spark)).count() == 0
    none = language_model.language_model(docs, empty(spark))[0].collect()
    assert all(r.base_score == 0 and math.isfinite(r.score) for r in none)


def test_quality_signals_and_verdict(spark):
    texts = [(i, f"{PASSAGE} The end of note {i} is here.") for i in range(150)]
    texts += [(200, "one two three " * 40), (201, "a b c\n" * 3 + PASSAGE), (202, PASSAGE.replace(" ", "### ")), (203, None), (204, "a b a b a"), (205, "x\x0by\x0cz 👩 é")]
    got = {r.doc_id: r for r in quality.quality(documents(spark, texts)).collect()}
    for i, t in texts:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = list(zip(w, w[1:], w[2:]))
        n = Counter(grams)
        repeat = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    assert all(got[i].kept for i in range(150)) and not got[202].kept and not got[202].base_failed and not got[200].kept


def test_quality_awkward_rows(spark):
    docs = awkward(spark)
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count() and all(r.kept is not None for r in rows)
    assert quality.quality(empty(spark)).count() == 0


def test_sketches_merge(spark):
    s = quality.signals(table(spark, SF, "documents"))
    fine, whole = quality.sketches(s), quality.sketches(s.withColumn("source", s.lang))
    a = {tuple(r) for r in quality.merged(fine, "lang").collect()}
    assert a == {tuple(r) for r in quality.merged(whole, "lang").collect()}


def test_fences_have_no_fixed_width(spark):
    word = "abcde abcdf abcdg abcdh abcdi abcdj abcdk abcdl abcdm abcdn ".split()
    text = lambda i, symbols: " ".join(f"{w}{i % 7}{k}" for k, w in enumerate(word * 10)) + " #" * symbols
    texts = [(i, text(i, 2 if i % 2 else 0), "en", "mixed") for i in range(200)] + [(i, text(i, 0), "en", "clean") for i in range(300, 500)]
    texts += [(900, text(0, 15), "en", "mixed"), (901, text(0, 2), "en", "mixed"), (902, text(0, 2), "en", "clean"), (903, text(0, 15), "en", "clean")]
    got = {r.doc_id: r.kept for r in quality.quality(documents(spark, texts)).collect()}
    # the same two symbols are usual in one source and an outlier in the other; fifteen are outliers in both
    assert all(got[i] for i in [*range(200), *range(300, 500), 901]) and not any(got[i] for i in (900, 902, 903))


def test_verdict_equals_brute_force(spark):
    """Groups above and below MIN_DOCS: fences per source, per language and over all, in plain Python."""
    rnd = random.Random(11)
    words = [f"word{'x' * (k % 9)}{k}" for k in range(400)]

    def text():
        w = rnd.choices(words, k=rnd.choice([30, 60, 120, 200]))
        w = [x + "#" * rnd.choice([0, 0, 0, 0, 1, 4]) for x in w]
        lines = [" ".join(w[i:i + 10]) for i in range(0, len(w), 10)]
        return "\n".join(lines + lines[:rnd.choice([0, 0, 0, 1, 3])])

    sizes = {("en", "big"): 160, ("en", "small"): 30, ("de", "a"): 70, ("de", "b"): 60, ("fr", None): 20, (None, "z"): 15}
    texts, i = [], 0
    for (lang, source), n in sizes.items():
        for _ in range(n):
            texts.append((i, text(), lang, source))
            i += 1
    texts += [(i, None, "en", "big"), (i + 1, "", "en", "big"), (i + 2, "#" * 50, "fr", None)]

    def measured(t):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        n = Counter(zip(w, w[1:], w[2:]))
        repeat = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        x = (sum(map(len, w)) * 1024 // max(len(w), 1), sum(c in "#*$%&|<>" for c in t) * 1024 // max(len(w), 1),
             (len(lines) - len(set(lines))) * 1024 // max(len(lines), 1), len(repeat) * 1024 // max(len(w), 1))
        return len(w), x, len(w) < 50 or 100 * len(repeat) > 50 * len(w)

    rows = [(i, lang or "", source or "", *measured(t)) for i, t, lang, source in texts]
    cell = lambda x: 1 << max(x.bit_length() - 8, 0)

    def fence(group, k):
        v = sorted(r[4][k] // cell(r[4][k]) * cell(r[4][k]) for r in group)
        q = lambda a, b: v[-(-a * len(v) // b) - 1]
        reach = 3 * (q(3, 4) - q(1, 4))
        high = max(q(3, 4) + reach, q(19, 20))
        return min(q(1, 4) - reach, q(1, 20)), high + cell(high) - 1

    used = [r for r in rows if r[3] > 0]
    got = {r.doc_id: r.kept for r in quality.quality(documents(spark, texts)).collect()}
    for r in rows:
        group = [o for o in used if o[1:3] == r[1:3]]
        if len(group) < quality.MIN_DOCS:
            group = [o for o in used if o[1] == r[1]]
        if len(group) < quality.MIN_DOCS:
            group = used
        inside = all(low <= r[4][k] <= high for k, (low, high) in enumerate(fence(group, k) for k in range(4)))
        assert got[r[0]] == (not r[5] and inside), r
    assert 0 < sum(got.values()) < len(got)


def test_sketch_fences_leave_few_beyond(spark):
    s = quality.signals(table(spark, SF, "documents")).filter("n_words > 0")
    whole = s.withColumns({"lang": quality.F.lit(""), "source": quality.F.lit("")})
    t = quality.thresholds(quality.sketches(whole)).first()
    for name, x in quality.ratios().items():
        values = [r[0] for r in whole.select(x).collect()]
        assert sum(v > t[f"{name}_high"] for v in values) * quality.TAIL <= len(values)
        assert sum(v < t[f"{name}_low"] for v in values) * quality.TAIL <= len(values)


def test_words_outside_the_classes_follow_their_context(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    lm = language_model
    monkeypatch.setattr(lm, "model_shape", lambda total, head: lm.Shape(64, 32, 256, 4096))
    scores, t = lm.language_model(docs, docs)
    got = {r.doc_id: r.score for r in scores.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    h, suffix, sizes = lm.hashed_tokens(list(texts.values()))
    rank, u = t.ranks(h), lm.previous(h, sizes)
    rest = rank >= t.shape.words
    count, pair, total = Counter(h[rest].tolist()), Counter(zip(u[rest].tolist(), h[rest].tolist())), Counter(u[rest].tolist())
    taken, after = Counter(), {}
    for (a, b), n in pair.items():
        after.setdefault(a, []).append(b)
        taken[a] += n - t.discount if n >= lm.LEAST_PAIR else 0

    def prob(a, b):
        n = pair[a, b]
        return (n - t.discount) / total[a] * (n >= lm.LEAST_PAIR) + (1 - taken[a] / total[a]) * (count[b] - t.discount) / t.rest_total

    unknown = t.discount * t.rest_distinct / t.rest_total
    for a in list(after)[:3]:
        assert math.isclose(sum(prob(a, b) for b in count) + (1 - taken[a] / total[a]) * unknown, 1, rel_tol=1e-9)
    at = t.contexts(rank, suffix, sizes)
    log = t.class_log[at, np.where(rest, t.shape.classes - 1, rank // t.shape.class_words)].astype(float)
    log[~rest] += t.word_log[at[~rest] % t.shape.contexts, rank[~rest]]
    log[rest] += [math.log10(prob(a, b)) for a, b in zip(u[rest].tolist(), h[rest].tolist())]
    want = dict(zip(texts, np.add.reduceat(log, np.cumsum(sizes) - sizes)))
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in texts)
    assert any(n >= lm.LEAST_PAIR for n in pair.values())


def test_training_follows_the_definition(spark, monkeypatch):
    """Features, gradients and updates recomputed token by token, with dictionaries."""
    lm = language_model
    monkeypatch.setattr(lm, "model_shape", lambda total, head: lm.Shape(6, 3, lm.SUFFIXES + 4, 40))
    texts = ["a b a c a b d e", "b a b a f g h", "c c a b", "", "x y a b a"] * 3
    docs = documents(spark, list(enumerate(texts)))
    t = lm.language_model(docs, docs)[1]
    s = t.shape
    h, suffix, sizes = lm.hashed_tokens(texts)
    rank = t.ranks(h).tolist()
    ids = [1 + lm.SUFFIXES + r if 0 <= r < 3 else 1 + x for r, x in zip(rank, suffix.tolist())]
    rows, at = [], 0
    for size in sizes.tolist():
        one = [0, 0, *ids[at:at + size]]
        for j in range(size):
            skip, last, r = one[j], one[j + 1], rank[at + j]
            hashed = (((skip * s.contexts + last) * 1103515245 + 12345) % 2147483647) % s.hashed
            rows.append((["bias", ("last", last), ("skip", skip), ("pair", hashed)], skip * s.contexts + last, last, r if r < 6 else None, min(r // 3, 2)))
        at += size
    w = Counter()

    def softmax(features, outs):
        e = {o: math.exp(sum(w[f, o] for f in features)) for o in outs}
        return {o: x / sum(e.values()) for o, x in e.items()}

    in_class = lambda c: [("word", r) for r in range(3 * c, 3 * c + 3)]
    for _ in range(lm.EPOCHS):
        seen, want = Counter(), Counter()
        for features, _, last, r, c in rows:
            for o, p in softmax(features, range(3)).items():
                for f in features:
                    seen[f, o] += o == c
                    want[f, o] += p
            if r is not None:
                both = ["bias", ("last", last)]
                for o, p in softmax(both, in_class(c)).items():
                    for f in both:
                        seen[f, o] += o == ("word", r)
                        want[f, o] += p
        for k in want:
            w[k] += 2 * (seen[k] - want[k]) / ((seen[k] + want[k]) / 2 + 1) / (2 if isinstance(k[1], tuple) else 4)
    for features, pair, last, r, c in rows:
        assert math.isclose(10 ** t.class_log[pair, c], softmax(features, range(3))[c], rel_tol=1e-4)
        if r is not None:
            assert math.isclose(10 ** t.word_log[last, r], softmax(["bias", ("last", last)], in_class(c))[("word", r)], rel_tol=1e-4)


def test_model_grows_with_the_corpus():
    shapes = [language_model.model_shape(10 ** e, 1 << 18) for e in range(3, 15)]
    for a, b in zip(shapes, shapes[1:]):
        assert b.words > a.words and b.classes >= a.classes and b.contexts > a.contexts and b.hashed > a.hashed
    assert shapes[-1].classes > 10 * shapes[0].classes
    assert 4 * language_model.model_shape(10 ** 13, 1 << 18).cells < 1 << 28
    assert language_model.model_shape(10 ** 13, 10).words == 10 and language_model.model_shape(0, 0).classes == 1


def test_pairs_grow_with_the_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    def pairs(d):
        t = language_model.head_tables(language_model.token_counts(d))
        sent = spark.sparkContext.broadcast(t)
        return language_model.repeated_pairs(language_model.training_counts(d, sent), sent).count()
    assert pairs(docs) > 1.5 * pairs(docs.filter("doc_id % 4 = 0"))


def test_token_hashes_name_tokens():
    rnd = random.Random(1)
    texts = ["", "a", " a  b\n", "É é\x1cz A", "x" * 5000, "   ", "aa a a a", *["".join(rnd.choices("abcdE \n\té日\x0b", k=200)) for _ in range(200)]]
    h, suffix, sizes = language_model.hashed_tokens(texts)
    tokens = [t.encode().lower().split() + [b""] for t in texts]
    flat = [x for w in tokens for x in w]
    assert sizes.tolist() == [len(w) for w in tokens] and len(h) == len(suffix) == len(flat)
    names = {}
    assert all(names.setdefault(x, y) == y for x, y in zip(flat, h.tolist())) and len(set(names.values())) == len(names)
    assert names[b""] == language_model.END
    words = sorted({x for r in duckdb_words() for x in r})
    assert len(set(language_model.token_hashes(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])).tolist())) == len(words)


def duckdb_words():
    import duckdb
    return [r[0].encode().lower().split() for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]


def test_texts_with_letters_stay_where_nothing_was_learned(spark):
    docs = documents(spark, [(1, "some words"), (2, "123 #"), (3, None), (4, "日本")])
    kept = language_id.keep_identified(docs, language_id.train(docs.limit(0)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == docs.columns


def test_prediction_is_the_nearest_prototype(spark):
    """Trigram vectors, prototypes and cosines recomputed from the letter vectors, text by text."""
    docs = table(spark, SF, "documents")
    learned = language_id.train(docs.filter(~language_id.held_out()))
    texts = {r.doc_id: r.text for r in docs.filter("doc_id % 7 = 0").collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs.filter("doc_id % 7 = 0"), learned).collect()}
    for i, t in texts.items():
        v = language_id.profiles([t or ""], language_id.DIMENSIONS)[0].astype(float)
        if not v.any():
            assert got[i] == ("und", 0.0)
            continue
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in learned.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i][0] == best and math.isclose(got[i][1], min(max(cosine[best], 0), 1), abs_tol=1e-4)

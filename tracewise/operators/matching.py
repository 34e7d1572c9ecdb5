"""Hierarchical labelling of chunks against reference texts.

Reference terms are extracted once per sample (not once per chunk).  A sample
is one text and its references; ``with_labels`` holds its chunks against its
reference terms where they lie, as arrays in one row, so that no term is shuffled.
Each distinct pair of strings of a batch is judged once; the ratio takes only the
pairs that the exact rules left open and that share enough characters to reach the threshold.

``object_exists`` is the same cascade over a table of terms: each stage is an
equi-join keyed by ``sample_id`` plus the term, its canonical form, a seed
gram or a rare character (``fuzzy``).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from ..functions.lexicons import GENERIC_WORDS, RELATIONS, attribute_category, attribute_category_map, canonical, lemma_of, noun_lemma, synonym_map
from ..functions.text import PY_WORD, strip, words
from ..session import materialize
from . import chunks as chunk_ops
from . import tagger
from .features import CHUNK_FEATURES
from .fuzzy import any_met, contained_pairs, lists, ratio_judge, similar_pairs

KEY = "sample_id"
TRUTH = ("gt_objects", "gt_attributes", "gt_relations")
LABELS = ("CATEGORY_HALLUC", "ATTRIBUTE_HALLUC", "RELATION_HALLUC", "CORRECT")


# ---------------------------------------------------------------- truth terms
def truth_objects(gt_tokens: DataFrame) -> DataFrame:
    """(sample_id, obj): lower lemmas of non-stop nouns of the references."""
    t = gt_tokens.filter(F.col("pos").isin("NOUN", "PROPN") & ~F.col("is_stop"))
    return t.select(KEY, F.lower("lemma").alias("obj")).distinct()


def truth_attributes(gt_texts: DataFrame, gt_tokens: DataFrame, text_col: str = "gt_text") -> DataFrame:
    """(sample_id, category, attr).

    Whitespace words of the lower-cased text found in the five lexicons
    (first category wins; punctuation stays attached, as in ``split()``),
    plus non-stop adjective lemmas, unknown ones under ``other``.
    """
    w = gt_texts.select(KEY, F.explode(words(F.lower(F.col(text_col)))).alias("attr"))
    w = w.select(KEY, attribute_category(F.col("attr")).alias("category"), "attr").filter(
        F.col("category").isNotNull())
    a = gt_tokens.filter((F.col("pos") == "ADJ") & ~F.col("is_stop")).select(KEY, F.lower("lemma").alias("attr"))
    a = a.select(KEY, F.coalesce(attribute_category(F.col("attr")), F.lit("other")).alias("category"), "attr")
    return w.unionByName(a).distinct()


def truth_relations(gt_texts: DataFrame, text_col: str = "gt_text") -> DataFrame:
    """(sample_id, rel): every relation phrase occurring as a substring (C11)."""
    lex = F.array(*[F.lit(r) for r in RELATIONS])
    low = F.lower(F.col(text_col))
    return gt_texts.select(KEY, F.explode(F.filter(lex, lambda r: low.contains(r))).alias("rel")).distinct()


TRUTH_TYPE = StructType([StructField("gt_objects", ArrayType(StringType())), StructField("gt_attributes", ArrayType(StructType([
    StructField("category", StringType()), StructField("attr", StringType())]))), StructField("gt_relations", ArrayType(StringType()))])
_CATEGORY, _SYNONYM, _GENERIC = attribute_category_map(), synonym_map(), set(GENERIC_WORDS)


_PHRASES = sorted({*RELATIONS})


def _truth_run(row: np.ndarray, texts: list[str], n: int) -> pa.Array:
    """Reference terms of ``n`` samples, whose texts are those with their ``row``."""
    t = tagger.tokens_of(texts)
    of = row[t.row]
    wanted = ~t.are(lambda w: w.is_stop)
    ends = lambda rows: pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())
    lemmas = [w.lemma.lower() for w in t.words]
    names = sorted({*lemmas})
    rank = {x: i for i, x in enumerate(names)}
    number = np.fromiter((rank[x] for x in lemmas), np.int64, len(lemmas))[t.word]
    o = t.are(lambda w: w.pos in ("NOUN", "PROPN")) & wanted
    in_row, which = np.divmod(np.unique(of[o] * max(len(names), 1) + number[o]), max(len(names), 1))
    objects = pa.ListArray.from_arrays(ends(in_row), pa.array(names, pa.string()).take(pa.array(which)))
    low = [x.lower() for x in texts]
    listed = {(i, _CATEGORY[w], w) for i, x in zip(row.tolist(), low) for w in _CATEGORY.keys() & x.split()}
    a = np.flatnonzero(t.are(lambda w: w.pos == "ADJ") & wanted)
    listed |= {(i, _CATEGORY.get(names[k], "other"), names[k]) for i, k in zip(of[a].tolist(), number[a].tolist())}
    listed = sorted(listed)
    pair = pa.StructArray.from_arrays([pa.array([x[k] for x in listed], pa.string()) for k in (1, 2)], ["category", "attr"])
    attributes = pa.ListArray.from_arrays(ends(np.array([i for i, *_ in listed], np.int64)), pair)
    # a sample's texts in one, behind a sign that no phrase has
    at = np.searchsorted(row, np.arange(n + 1)).tolist()
    every = ["\0".join(low[a:b]) for a, b in zip(at, at[1:])]
    relations = pa.array([[r for r in _PHRASES if r in x] for x in every], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([objects, attributes, relations], TRUTH)


def _sizes(offsets: np.ndarray, flat: pa.Array) -> np.ndarray:
    """Bytes of each list of texts."""
    if len(offsets) == 1:
        return np.zeros(0, np.int64)
    each = pa.compute.fill_null(pa.compute.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return np.add.reduceat(np.append(each, 0), offsets[:-1]) * (np.diff(offsets) > 0)


def _truth_rows(offsets: np.ndarray, flat: pa.Array, first: int, stop: int) -> pa.Array:
    """Reference terms of the rows from ``first`` to before ``stop`` of a list column."""
    lo, hi = offsets[first], offsets[stop]
    return _truth_run(np.repeat(np.arange(stop - first), np.diff(offsets[first:stop + 1])), flat.slice(lo, hi - lo).to_pylist(), stop - first)


@F.arrow_udf(TRUTH_TYPE)
def _truth_of(texts: pa.Array) -> pa.Array:
    offsets, flat = lists(texts)
    runs = [_truth_rows(offsets, flat, first, stop) for first, stop in tagger.runs(pa.array(_sizes(offsets, flat)))]
    return pa.concat_arrays(runs or [_truth_run(np.zeros(0, np.int64), [], 0)])


def with_truth(df: DataFrame, texts: str = "gt_texts") -> DataFrame:
    """``truth_objects``, ``truth_attributes`` and ``truth_relations`` of each sample's array of references by the default tagger, as sorted sets.

    A sample without references (null) has null sets.
    """
    d = df.withColumn("_truth", _truth_of.asNondeterministic()(F.coalesce(F.col(texts), F.array().cast("array<string>"))))
    return d.select("*", *[F.when(F.col(texts).isNotNull(), F.col("_truth")[c]).alias(c) for c in TRUTH]).drop("_truth")


# ---------------------------------------------------------------- C5
def object_exists(terms: DataFrame, gt_objects: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(sample_id, term, exists) for distinct (sample, term).

    A term exists when any holds: it is a generic scene word; equal to a
    reference object; same canonical form; one contains the other with both
    longer than 3 characters; a word of it, or that word's lemma, has the
    canonical form of a reference object; ratio >= 0.7 (if ``fuzzy``).
    Each stage takes only the terms that the stages before it left open.
    """
    t = terms.select(KEY, "term").distinct().withColumn("_ol", F.lower(strip(F.col("term"))))
    g = gt_objects.select(KEY, F.lower("obj").alias("_gl")).distinct().withColumn("_gc", canonical(F.col("_gl")))
    # canonical form of the whole term (which covers equality) and of its words and their lemmas
    in_term = F.regexp_extract_all(F.col("_ol"), F.lit(f"[{PY_WORD}]+"), 0)
    forms = F.array_union(F.array(canonical(F.col("_ol"))), F.flatten(F.transform(
        in_term, lambda w: F.array(canonical(w), canonical(noun_lemma(w))))))
    named = t.select(KEY, "term", F.explode(forms).alias("_gc")).join(g.select(KEY, "_gc").distinct(), [KEY, "_gc"], "left_semi")
    hits = t.filter(F.col("_ol").isin(*GENERIC_WORDS)).select(KEY, "term").unionByName(named.select(KEY, "term")).distinct()
    hits = materialize(hits)
    rest = materialize(t.join(hits, [KEY, "term"], "left_anti"))
    # substring, both longer than 3, either way round
    asked, given = rest.filter(F.length("_ol") > 3).select(KEY, "_ol"), g.filter(F.length("_gl") > 3).select(KEY, "_gl")
    within = contained_pairs(asked, given, [KEY], "_ol", "_gl").unionByName(
        contained_pairs(given, asked, [KEY], "_gl", "_ol").select(KEY, "_ol", "_gl")).select(KEY, "_ol").distinct()
    if fuzzy:
        within = materialize(within)
        open_ = rest.select(KEY, "_ol").join(within, [KEY, "_ol"], "left_anti")
        near = similar_pairs(open_, g, [KEY], "_ol", "_gl", 0.7).select(KEY, "_ol").distinct()
        within = within.unionByName(near)
    late = rest.join(within, [KEY, "_ol"], "left_semi").select(KEY, "term")
    return t.join(hits.unionByName(late).withColumn("exists", F.lit(True)), [KEY, "term"], "left").select(
        KEY, "term", F.coalesce(F.col("exists"), F.lit(False)).alias("exists"))


def chunk_terms(c: Column) -> Column:
    """The object terms of a chunk: itself, its object, or all of its objects."""
    return F.when(c["chunk_type"] == "object", F.array(c["chunk_text"])).when(c["chunk_type"] == "attribute", F.array(c["object"])).otherwise(c["objects"])


@functools.lru_cache(maxsize=1 << 16)
def _forms(term: str) -> frozenset[str]:
    """Canonical forms of a term and of its words and their lemmas."""
    words = re.findall(r"\w+", term)
    return frozenset(_SYNONYM.get(w, w) for w in [term, *words, *map(lemma_of, words)])


def _existence_judge(words: list[str], fuzzy: bool):
    """Whether a term (a number in ``words``) exists beside a reference object: the rules of ``object_exists`` but for the generic words."""
    near = ratio_judge(words, 0.7)

    def judge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        def same(a, b):
            return _SYNONYM.get(b, b) in _forms(a) or (len(a) > 3 and len(b) > 3 and (a in b or b in a))
        ok = np.fromiter((same(words[i], words[j]) for i, j in zip(x.tolist(), y.tolist())), bool, len(x))
        if fuzzy:
            rest = np.flatnonzero(~ok)
            ok[rest] = near(x[rest], y[rest])
        return ok
    return judge


def _distinct_met(row: np.ndarray, code: np.ndarray, offsets: np.ndarray, given: np.ndarray, n_words: int, judge) -> np.ndarray:
    """``any_met`` with each row's distinct strings asked once."""
    keys, back = np.unique(row * max(n_words, 1) + code, return_inverse=True)
    return any_met(keys // max(n_words, 1), keys % max(n_words, 1), offsets, given, n_words, judge)[back]


def _numbered(*parts: pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """Strings as numbers of one list; null is -1."""
    both = pa.concat_arrays([p.cast(pa.string()) for p in parts]).dictionary_encode()
    code = pa.compute.fill_null(both.indices, -1).to_numpy()
    return np.split(code.astype(np.int64), np.cumsum([len(p) for p in parts])[:-1]), both.dictionary.to_pylist()


def _remapped(words: list[str], to) -> tuple[np.ndarray, list[str]]:
    """The number of each word's ``to`` form in the list of these forms; the last entry serves -1."""
    forms: dict[str, int] = {}
    number = [forms.setdefault(to(w), len(forms)) for w in words]
    return np.array([*number, -1], np.int64), list(forms)


def _asked(term: str) -> str:
    return term.strip().lower()


def _terms_met(keyed: np.ndarray, row: np.ndarray, code: np.ndarray, words: list[str], offsets: np.ndarray, given: np.ndarray, fuzzy: bool) -> np.ndarray:
    """Whether each term exists among its row's reference objects; null terms are not asked."""
    at, forms = _remapped([*map(_asked, words), *(w.lower() for w in words)], str)
    n = len(words)
    ask, give = at[:n][code], at[n:-1][given]
    generic = np.fromiter((w in _GENERIC for w in forms), bool, len(forms))
    ok = np.zeros(len(code), bool)
    open_ = np.flatnonzero((code >= 0) & keyed[row])
    ok[open_] = generic[ask[open_]]
    open_ = open_[~ok[open_]]
    ok[open_] = _distinct_met(row[open_], ask[open_], offsets, give, len(forms), _existence_judge(forms, fuzzy))
    return ok


def _existing(fuzzy: bool):
    def run(keyed: pa.Array, terms: pa.Array, given: pa.Array) -> pa.Array:
        t0, terms = lists(terms)
        g0, given = lists(given)
        (code, gave), words = _numbered(terms, given)
        row = np.repeat(np.arange(len(t0) - 1), np.diff(t0))
        ok = _terms_met(keyed.to_numpy(zero_copy_only=False), row, code, words, g0, gave, fuzzy)
        return pa.ListArray.from_arrays(pa.array(t0, pa.int32()), pa.array(ok))
    run.__annotations__ = {"keyed": pa.Array, "terms": pa.Array, "given": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(BooleanType())).asNondeterministic()


def with_existing(samples: DataFrame, terms: Column, fuzzy: bool = True) -> DataFrame:
    """``samples`` with ``_terms``, their distinct object terms, and ``_exist``, those among the sample's objects (C5; rules: ``object_exists``)."""
    none = F.array().cast("array<string>")
    asked = F.array_distinct(F.filter(F.when(F.col(KEY).isNotNull(), terms).otherwise(none), lambda t: t.isNotNull()))
    d = samples.withColumn("_terms", asked)
    d = d.withColumn("_ok", _existing(fuzzy)(F.col(KEY).isNotNull(), F.col("_terms"), F.coalesce(F.col("gt_objects"), none)))
    met = F.filter(F.arrays_zip("_terms", "_ok"), lambda x: x["_ok"])
    return d.withColumn("_exist", F.transform(met, lambda x: x["_terms"])).drop("_ok")


# ---------------------------------------------------------------- labels
JUDGED_TYPE = ArrayType(StructType([StructField("missing_objects", ArrayType(StringType())), StructField("object_ok", BooleanType()),
                                    StructField("attribute_ok", BooleanType()), StructField("relation_ok", BooleanType()), StructField("chunk_label", StringType())]))

JUDGED_BY = ("chunk_type", "chunk_text", "attribute", "object", "relation", "objects")
LABELLED = (*chunk_ops.CHUNK_TYPE.elementType.names, *JUDGED_TYPE.elementType.names)


def _judge(fuzzy: bool):
    """The verdict on each chunk of a batch of samples."""
    def run(keyed: pa.Array, kind: pa.Array, text: pa.Array, attribute: pa.Array, noun: pa.Array, relation: pa.Array, objects: pa.Array,
            gt_objects: pa.Array, gt_attributes: pa.Array, gt_relations: pa.Array) -> pa.Array:
        offsets, kind = lists(kind)
        text, attribute, noun, relation = (lists(x)[1] for x in (text, attribute, noun, relation))
        own = lists(objects)[1]
        many = pa.compute.fill_null(pa.compute.list_value_length(own), 0).to_numpy()
        n0, own = np.concatenate([[0], np.cumsum(many)]), own.flatten()
        (g0, gt_o), (a0, gt_a), (r0, gt_r) = (lists(x) for x in (gt_objects, gt_attributes, gt_relations))
        keyed = keyed.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        is_a, is_r, is_o = (pa.compute.fill_null(pa.compute.equal(kind, k), False).to_numpy(zero_copy_only=False) for k in ("attribute", "relation", "object"))

        # objects: the chunk's text, its object, or all of its objects
        (c_text, c_noun, c_own, c_given), words = _numbered(text, noun, own, gt_o)
        n = np.where(is_o | is_a, 1, many)
        t0 = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(np.arange(len(n)), n)
        listed = ~(is_o | is_a)[of]
        code = np.where(is_o, c_text, c_noun)[of]
        code[listed] = c_own[(n0[of] + np.arange(len(of)) - t0[of])[listed]]
        lacking = (code >= 0) & ~_terms_met(keyed, row[of], code, words, g0, c_given, fuzzy)
        lacks = np.bincount(of[lacking], minlength=len(n))
        missing = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lacks)]), pa.int32()), pa.array(words, pa.string()).take(pa.array(code[lacking])))
        object_ok = lacks == 0

        def held(some, c, r0, given, judge_of, words):
            """Whether the words ``c`` of the chunks ``some`` are among, or by ``judge_of(words)`` near, those of their sample."""
            ok = np.zeros(len(n), bool)
            which = np.flatnonzero(some & (c >= 0))
            ok[which] = _distinct_met(row[which], c[which], r0, given, len(words), judge_of(words))
            return ok

        # attributes: a word of no lexicon passes where the references have no attribute at all; two such need a ratio of 0.7, others 0.8
        (c, gave), words = _numbered(attribute, gt_a)
        at, forms = _remapped([*map(_asked, words), *words], str)
        c, gave = np.where(c >= 0, at[:len(words)][c] if words else c, -1), at[len(words):-1][gave]
        unlisted = np.fromiter((w not in _CATEGORY for w in forms), bool, len(forms))
        bare = np.diff(a0)[row] == 0

        def attribute_judge(words):
            strict, loose = ratio_judge(words, 0.8), ratio_judge(words, 0.7)

            def judge(x, y):
                ok = x == y
                if fuzzy:
                    both = unlisted[x] & unlisted[y]
                    for judge, some in ((loose, both), (strict, ~both)):
                        rest = np.flatnonzero(~ok & some)
                        ok[rest] = judge(x[rest], y[rest])
                return ok
            return judge

        attr = held(is_a, c, a0, gave, attribute_judge, forms)
        if len(forms):
            attr |= is_a & (c >= 0) & bare & unlisted[c]

        def relation_judge(words):
            near = ratio_judge(words, 0.7)

            def judge(x, y):
                ok = x == y
                if fuzzy:
                    ok |= near(x, y)
                return ok
            return judge

        (c, gave), words = _numbered(relation, gt_r)
        at, forms = _remapped([*(w.lower() for w in words), *words], str)
        c, gave = np.where(c >= 0, at[:len(words)][c] if words else c, -1), at[len(words):-1][gave]
        rel = held(is_r, c, r0, gave, relation_judge, forms)
        attr, rel = attr & object_ok, rel & object_ok
        label = np.where(~object_ok, 0, np.where(is_a & ~attr, 1, np.where(is_r & ~rel, 2, 3)))
        fields = [missing, pa.array(object_ok), pa.array(attr, mask=~is_a), pa.array(rel, mask=~is_r), pa.array(LABELS).take(pa.array(label))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, JUDGED_TYPE.elementType.names))
    return run


def _judged(fuzzy: bool):
    run = _judge(fuzzy)
    run.__annotations__ = {k: pa.Array for k in ("keyed", "kind", "text", "attribute", "noun", "relation", "objects", "gt_objects", "gt_attributes", "gt_relations", "return")}
    # declared nondeterministic (it is not), so that Spark computes it once and copies it into no later expression
    return F.arrow_udf(run, JUDGED_TYPE).asNondeterministic()


def _labelled(fuzzy: bool, fields: tuple):
    """Texts and their references to labelled chunks, with ``fields`` of each."""
    judge = _judge(fuzzy)

    def one(keyed: pa.Array, texts: pa.Array, truth: pa.Array) -> pa.Array:
        texts = [t or "" for t in texts.to_pylist()]
        chunks = chunk_ops.chunk_run(texts, keyed.to_numpy(zero_copy_only=False))
        listed = lambda a, field: pa.ListArray.from_arrays(a.offsets, a.values.field(field))
        of = [listed(chunks, c) for c in JUDGED_BY]
        judged = judge(keyed, *of, truth.field("gt_objects"), listed(truth.field("gt_attributes"), "attr"), truth.field("gt_relations"))
        source = {f.name: a.field(f.name) for a in (chunks.values, judged.values) for f in a.type}
        if not source.keys() >= set(fields):
            source |= chunk_ops.feature_arrays(chunks, texts)
        parts = [source[f] for f in fields]
        return pa.ListArray.from_arrays(chunks.offsets, pa.StructArray.from_arrays(parts, list(fields)))

    def run(keyed: pa.Array, texts: pa.Array, references: pa.Array) -> pa.Array:
        offsets, flat = lists(references)
        size = pa.array(_sizes(offsets, flat) + pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        runs = [one(keyed.slice(a, b - a), texts.slice(a, b - a), _truth_rows(offsets, flat, a, b)) for a, b in tagger.runs(size)]
        return pa.concat_arrays(runs or [one(keyed, texts, _truth_run(np.zeros(0, np.int64), [], 0))])
    run.__annotations__ = {k: pa.Array for k in ("keyed", "texts", "references", "return")}
    types = {f.name: f.dataType for t in (chunk_ops.CHUNK_TYPE, JUDGED_TYPE) for f in t.elementType} | {f: DoubleType() for f in CHUNK_FEATURES}
    # declared nondeterministic (it is not), so that Spark computes it once and copies it into no later expression
    return F.arrow_udf(run, ArrayType(StructType([StructField(f, types[f]) for f in fields]))).asNondeterministic()


def labelled_texts(samples: DataFrame, text_col: str, texts: str = "gt_texts", fuzzy: bool = True, fields: tuple = (), keep: tuple = ()) -> DataFrame:
    """(sample_id, ``keep``, chunks): ``with_chunks``, ``with_truth`` and ``with_labels`` of texts and their references in one pass.

    A text is tagged, cut and judged where it lies, so that tokens, chunks and reference terms never leave Python;
    what comes out is ``fields`` of each chunk (default: all that ``with_labels`` gives), which may be the numbers of ``chunk_features`` as well.
    """
    given = F.coalesce(F.col(texts), F.array().cast("array<string>"))
    chunks = _labelled(fuzzy, tuple(fields) or LABELLED)(F.col(KEY).isNotNull(), F.col(text_col), given)
    return samples.select(KEY, *keep, chunks.alias("chunks"))


def with_labels(samples: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``samples`` (a text's ``chunks`` and its ``gt_`` arrays) with the chunks labelled.

    Adds ``object_ok``, ``missing_objects``, ``attribute_ok``, ``relation_ok`` and ``chunk_label`` to every chunk.
    object chunk: its text must exist.  attribute chunk: its object must
    exist, then the attribute test.  relation chunk: all objects must exist,
    then the relation test.  ``missing_objects`` lists the chunk's objects
    that do not exist, in their order in the chunk.
    """
    none = F.array().cast("array<string>")
    of = [F.col("chunks")[c] for c in JUDGED_BY]
    given = [F.coalesce(c, none) for c in (F.col("gt_objects"), F.col("gt_attributes")["attr"], F.col("gt_relations"))]
    d = samples.withColumn("_judged", _judged(fuzzy)(F.col(KEY).isNotNull(), *of, *given))
    every = F.zip_with("chunks", "_judged", lambda c, j: F.struct(*[(j if f in JUDGED_TYPE.elementType.names else c)[f].alias(f) for f in LABELLED]))
    return d.withColumn("chunks", every).select(*samples.columns)


def label_explanations(labelled: DataFrame, gt_objects: DataFrame, gt_attrs: DataFrame,
                       gt_rels: DataFrame) -> DataFrame:
    """Reason text and the sample's reference sets per chunk (C14).

    The reason names the chunk's missing objects, or the attribute or relation
    at fault, with the reference terms it was held against.
    """
    objs = gt_objects.groupBy(KEY).agg(F.array_sort(F.collect_set("obj")).alias("gt_objects"))
    attrs = gt_attrs.groupBy(KEY).agg(F.array_sort(F.collect_set(F.concat_ws(":", "category", "attr")))
                                      .alias("gt_attributes"))
    rels = gt_rels.groupBy(KEY).agg(F.array_sort(F.collect_set("rel")).alias("gt_relations"))
    return with_reasons(labelled.join(objs, KEY, "left").join(attrs, KEY, "left").join(rels, KEY, "left"))


def with_reasons(j: DataFrame) -> DataFrame:
    """``reasoning`` for labelled chunks that have their sample's reference sets beside them (arrays of strings)."""
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    t = F.col("chunk_type")
    lacking = F.concat(F.lit("Not among the reference objects: "), listed("missing_objects"), F.lit("; reference objects: "), listed("gt_objects"))
    attribute = F.concat(F.lit("Object '"), F.col("object"), F.lit("' exists; attribute '"), F.col("attribute"), F.when(
        F.col("attribute_ok"), F.lit("' is correct")).otherwise(F.concat(F.lit("' is incorrect; reference attributes: "), listed("gt_attributes"))))
    relation = F.concat(F.lit("Objects exist: "), listed("objects"), F.lit("; relation '"), F.col("relation"), F.when(
        F.col("relation_ok"), F.lit("' is correct")).otherwise(F.concat(F.lit("' is incorrect; reference relations: "), listed("gt_relations"))))
    reason = (F.when(~F.col("object_ok"), lacking).when(t == "attribute", attribute).when(t == "relation", relation)
               .otherwise(F.concat(F.lit("Object '"), F.col("chunk_text"), F.lit("' is among the reference objects"))))
    return j.withColumn("reasoning", reason)

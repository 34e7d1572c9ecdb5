"""Tagging, chunking and labelling queries.

The oracles restate the tagger and chunker in DuckDB and test the label
rules by brute force inside each sample (a theta join there is fine: it is
a small test, not the production plan).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lexicons import (ACTION_RELATIONS, GENERIC_WORDS, IRREGULAR_NOUNS, RELATIONS, TAGGER_ADJECTIVES, TAGGER_CLOSED,
                                  TAGGER_DETERMINERS, TAGGER_NOUNS, TAGGER_PREPOSITIONS, TAGGER_STOP_WORDS, TAGGER_SUFFIXES,
                                  attribute_category_map, synonym_map)
from ..functions.similarity import similarity
from ..functions.text import PY_WORD, PY_WS
from ..operators import chunks as chunk_ops
from ..operators import labelling, matching, tagger
from ..sources import fixtures, tables
from ..session import materialize
from ..sources.fixtures import ANN_ORDER
from .registry import register, rounded


def _q(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _values(d: dict, a: str, b: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in d.items())
    return f"(VALUES {rows}) t({a}, {b})"


SYN = f"syn AS (SELECT * FROM {_values(synonym_map(), 'word', 'base')})"
ACAT = f"acat AS (SELECT * FROM {_values(attribute_category_map(), 'word', 'category')})"

TEXTS = f"""li AS (SELECT l.l_orderkey, {', '.join('l.' + c for c in ANN_ORDER)}, p.p_name,
                  CASE WHEN l.l_suppkey % 2 = 0 THEN 'gen' ELSE 'gt' END AS side
           FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
sen AS (SELECT l_orderkey AS sample_id, side, CAST(row_number() OVER w - 1 AS INTEGER) AS pos,
          CASE l_linenumber % 4
            WHEN 0 THEN 'A ' || p_name || ' on a ' || coalesce(lead(p_name) OVER w, p_name) || '.'
            WHEN 1 THEN 'The ' || p_name || ' holding the ' || coalesce(lead(p_name) OVER w, p_name) || '.'
            WHEN 2 THEN 'One ' || p_name || ' beside a ' || coalesce(lead(p_name) OVER w, p_name) || '.'
            ELSE 'A ' || p_name || '.' END AS sentence
        FROM li WINDOW w AS (PARTITION BY l_orderkey, side ORDER BY {', '.join(ANN_ORDER)})),
gen AS (SELECT sample_id, string_agg(sentence, ' ' ORDER BY pos) AS generated_description
        FROM sen WHERE side = 'gen' GROUP BY sample_id),
refs AS (SELECT sample_id, pos AS gt_idx, sentence AS gt_text FROM sen WHERE side = 'gt')"""


def _lemma_sql(w: str) -> str:
    """DuckDB restatement of lexicons.noun_lemma."""
    irregular = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in IRREGULAR_NOUNS.items())
    return f"""CASE {irregular}
      WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y'
      WHEN length({w}) > 4 AND regexp_matches({w}, '(ss|sh|ch|x|z)es$') THEN left({w}, length({w}) - 2)
      WHEN length({w}) > 3 AND suffix({w}, 's') AND NOT regexp_matches({w}, '(ss|us|is)$') THEN left({w}, length({w}) - 1)
      ELSE {w} END"""


def _tagger_sql(name: str, src: str, ids: list[str], text: str) -> str:
    i = ", ".join(ids)
    pieces = f"[{PY_WS}]+|[{PY_WORD}]+|[^{PY_WORD}{PY_WS}]"
    noun = "pos IN ('NOUN', 'PROPN')"
    rel = "pos IN ('ADP', 'VERB')"
    return f"""{name}_p AS (
  SELECT {i}, unnest(arr) AS piece, unnest(generate_series(1, len(arr))) AS pi
  FROM (SELECT {i}, regexp_extract_all(coalesce({text}, ''), '{pieces}') AS arr FROM {src})),
{name}_o AS (
  SELECT {i}, pi, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {i} ORDER BY pi
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start FROM {name}_p),
{name}_t AS (
  SELECT {i}, CAST(row_number() OVER (PARTITION BY {i} ORDER BY pi) - 1 AS INTEGER) AS tok_idx,
         piece AS text, CASE WHEN pos = 'NOUN' THEN nl ELSE lower(piece) END AS lemma, pos,
         char_start, CAST(char_start + length(piece) AS INTEGER) AS char_end,
         lower(piece) IN ({_q(TAGGER_STOP_WORDS)}) AS is_stop
  FROM (SELECT *, CASE WHEN nl IN ({_q(TAGGER_NOUNS)}) THEN 'NOUN'
              WHEN lower(piece) IN ({_q(TAGGER_ADJECTIVES)}) THEN 'ADJ'
              WHEN lower(piece) IN ({_q(TAGGER_PREPOSITIONS)}) THEN 'ADP'
              WHEN lower(piece) IN ({_q(ACTION_RELATIONS)}) THEN 'VERB'
              WHEN lower(piece) IN ({_q(TAGGER_DETERMINERS)}) THEN 'DET'
              WHEN NOT regexp_matches(piece, '[{PY_WORD}]') THEN 'PUNCT'
              WHEN lower(piece) IN ({_q(TAGGER_STOP_WORDS + TAGGER_CLOSED)}) OR regexp_matches(piece, '[\\p{{N}}_]') THEN 'X'
              {' '.join(f"WHEN length(piece) > 4 AND regexp_matches(lower(piece), '{e}') THEN '{k}'" for k, e in TAGGER_SUFFIXES)}
              ELSE 'NOUN' END AS pos
        FROM (SELECT *, {_lemma_sql('lower(piece)')} AS nl FROM {name}_o WHERE NOT regexp_full_match(piece, '[{PY_WS}]+')))),
{name}_s AS (
  SELECT *, coalesce(sum(CASE WHEN text IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY {i}
         ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM {name}_t),
{name}_n AS (
  SELECT *, min(CASE WHEN {noun} THEN tok_idx END) OVER fw AS nn, max(CASE WHEN {noun} THEN tok_idx END) OVER bw AS pn,
            min(CASE WHEN {rel} THEN tok_idx END) OVER fw AS nr, max(CASE WHEN {rel} THEN tok_idx END) OVER bw AS pr
  FROM {name}_s
  WINDOW fw AS (PARTITION BY {i}, sent ORDER BY tok_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
         bw AS (PARTITION BY {i}, sent ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_h AS (
  SELECT *, CAST(CASE
      WHEN pos IN ('ADJ', 'DET') AND nn IS NOT NULL THEN nn
      WHEN {noun} AND pr IS NOT NULL AND (pn IS NULL OR pn < pr) THEN pr
      WHEN {noun} AND nr IS NOT NULL AND (nn IS NULL OR nn > nr) THEN nr
      ELSE tok_idx END AS INTEGER) AS head_idx FROM {name}_n),
{name} AS (
  SELECT {i}, tok_idx, text, lemma, pos,
         CASE WHEN pos = 'ADP' THEN 'prep' WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'DET' THEN 'det'
              WHEN head_idx = tok_idx THEN 'ROOT' ELSE 'dep' END AS dep,
         head_idx, char_start, char_end, is_stop FROM {name}_h)"""


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^[{PY_WS}]+|[{PY_WS}]+$', '', 'g')"
CHUNKS = f"""{TEXTS},
{_tagger_sql('tok', "(SELECT * FROM gen WHERE generated_description <> '')", ['sample_id'], 'generated_description')},
u AS (
  SELECT sample_id, text AS chunk_text, 'object' AS chunk_type, 0 AS type_rank, tok_idx AS tok_key,
         char_start AS "start", char_end AS "end", NULL::VARCHAR AS attribute, NULL::VARCHAR AS object,
         NULL::VARCHAR AS relation, NULL::VARCHAR[] AS objects
  FROM tok WHERE pos IN ('NOUN', 'PROPN') AND NOT is_stop
  UNION ALL
  SELECT a.sample_id, a.text || ' ' || h.text, 'attribute', 1, a.tok_idx, a.char_start, h.char_end, a.text, h.text,
         NULL, NULL
  FROM tok a JOIN tok h ON h.sample_id = a.sample_id AND h.tok_idx = a.head_idx
  WHERE a.pos = 'ADJ' AND h.pos IN ('NOUN', 'PROPN')
  UNION ALL
  SELECT sample_id, objs[1] || ' ' || relation || ' ' || objs[2], 'relation', 2, tok_idx, s, e, NULL, NULL,
         relation, objs
  FROM (SELECT r.sample_id, r.tok_idx, r.text AS relation, list(c.text ORDER BY c.tok_idx) AS objs,
               min(c.char_start) AS s, max(c.char_end) AS e
        FROM tok r JOIN tok c ON c.sample_id = r.sample_id AND c.head_idx = r.tok_idx AND c.tok_idx <> r.tok_idx
        WHERE (r.dep IN ('prep', 'agent') OR r.pos = 'VERB') AND c.pos IN ('NOUN', 'PROPN')
        GROUP BY r.sample_id, r.tok_idx, r.text HAVING count(*) >= 2)),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, lower(chunk_text)
                                                   ORDER BY type_rank, tok_key) AS rk
                      FROM u WHERE length({STRIP('chunk_text')}) > 2) WHERE rk = 1),
dflt AS (SELECT g.sample_id, g.generated_description AS chunk_text, 'object' AS chunk_type, 0 AS type_rank,
                -1 AS tok_key, 0 AS "start", CAST(length(g.generated_description) AS INTEGER) AS "end",
                NULL::VARCHAR AS attribute, NULL::VARCHAR AS object, NULL::VARCHAR AS relation,
                NULL::VARCHAR[] AS objects
         FROM gen g WHERE g.generated_description <> ''
           AND g.sample_id NOT IN (SELECT sample_id FROM dd)),
ch AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY "start", type_rank, tok_key) - 1 AS INTEGER)
              AS chunk_idx
       FROM (SELECT sample_id, chunk_text, chunk_type, type_rank, tok_key, "start", "end", attribute, object,
                    relation, objects FROM dd UNION ALL SELECT * FROM dflt))"""

TRUTH = f"""{_tagger_sql('gtok', "(SELECT * FROM refs WHERE gt_text <> '')", ['sample_id', 'gt_idx'], 'gt_text')},
{SYN}, {ACAT},
gobj AS (SELECT DISTINCT sample_id, lower(lemma) AS obj FROM gtok WHERE pos IN ('NOUN', 'PROPN') AND NOT is_stop),
gattr AS (
  SELECT DISTINCT sample_id, category, attr FROM (
    SELECT w.sample_id, a.category, w.attr FROM (
      SELECT sample_id, unnest(list_filter(regexp_split_to_array(lower(gt_text), '[{PY_WS}]+'), lambda x: x <> ''))
             AS attr FROM refs WHERE gt_text <> '') w JOIN acat a ON a.word = w.attr
    UNION ALL
    SELECT t.sample_id, coalesce(a.category, 'other'), lower(t.lemma) FROM gtok t
      LEFT JOIN acat a ON a.word = lower(t.lemma) WHERE t.pos = 'ADJ' AND NOT t.is_stop)),
grel AS (SELECT DISTINCT sample_id, unnest(list_filter([{_q(RELATIONS)}], lambda r: contains(lower(gt_text), r)))
         AS rel FROM refs WHERE gt_text <> '')"""

EXISTS = f"""
terms AS (SELECT DISTINCT sample_id, term FROM (
  SELECT sample_id, CASE WHEN chunk_type = 'object' THEN chunk_text ELSE object END AS term FROM ch
  WHERE chunk_type IN ('object', 'attribute')
  UNION ALL SELECT sample_id, unnest(objects) FROM ch WHERE chunk_type = 'relation')),
tl AS (SELECT sample_id, term, lower({STRIP('term')}) AS ol FROM terms),
tc AS (SELECT tl.*, coalesce(s.base, tl.ol) AS oc FROM tl LEFT JOIN syn s ON s.word = tl.ol),
gc AS (SELECT g.sample_id, g.obj, coalesce(s.base, g.obj) AS gcan FROM gobj g LEFT JOIN syn s ON s.word = g.obj),
tw0 AS (SELECT sample_id, term, unnest(regexp_extract_all(ol, '[{PY_WORD}]+')) AS w FROM tl),
tw AS (SELECT sample_id, term, coalesce(s.base, w) AS wc FROM (
         SELECT sample_id, term, w FROM tw0 UNION SELECT sample_id, term, {_lemma_sql('w')} FROM tw0) x
       LEFT JOIN syn s ON s.word = x.w),
ex AS (SELECT tc.sample_id, tc.term,
  tc.ol IN ({_q(GENERIC_WORDS)})
  OR EXISTS (SELECT 1 FROM gc WHERE gc.sample_id = tc.sample_id AND (gc.gcan = tc.oc
             OR (length(tc.ol) > 3 AND length(gc.obj) > 3 AND (contains(gc.obj, tc.ol) OR contains(tc.ol, gc.obj)))))
  OR EXISTS (SELECT 1 FROM tw JOIN gc ON gc.sample_id = tw.sample_id AND gc.gcan = tw.wc
             WHERE tw.sample_id = tc.sample_id AND tw.term = tc.term) AS "exists"
  FROM tc)"""


def _inputs(spark, sf, only=None):
    return labelling.prepare(fixtures.generations(spark, sf, only), fixtures.references(spark, sf, only))


@register("tagged_tokens", "F5 (default lexicon tagger -> tokens table)", f"""
WITH {TEXTS}, {_tagger_sql('tok', "(SELECT * FROM gen WHERE generated_description <> '')", ['sample_id'],
                           'generated_description')}
SELECT * FROM tok""")
def tagged_tokens(spark, sf):
    g = fixtures.generations(spark, sf)
    return tagger.tag(g, ["sample_id"], "generated_description")


@register("tagged_documents", "F5 (default tagger with lemmas over whole documents)", f"""
WITH {_tagger_sql('tok', 'documents', ['doc_id'], 'text')}
SELECT * FROM tok""")
def tagged_documents(spark, sf):
    return tagger.tag(tables.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"), ["doc_id"], "text")


@register("chunks_extracted", "C1 C2 C3 C4 J10 J11 U2 W8 O3 (chunks in order)", f"""
WITH {CHUNKS}
SELECT sample_id, chunk_idx, chunk_text, chunk_type, "start", "end", attribute, object, relation,
       array_to_string(objects, '|') AS objects FROM ch""")
def chunks_extracted(spark, sf):
    c = labelling.prepare_generated(fixtures.generations(spark, sf)).chunks
    return c.select("sample_id", "chunk_idx", "chunk_text", "chunk_type", "start", "end", "attribute", "object",
                    "relation", F.array_join("objects", "|").alias("objects"))


FEATURE_COLS = ["chunk_word_count", "chunk_relative_position", "total_chunks_in_image",
                "chunk_position_normalized", "is_first_chunk", "is_last_chunk", "is_middle_chunk",
                "word_count_normalized", "is_short_chunk", "is_long_chunk", "chunks_density",
                "chunk_length_ratio", "position_length_interaction", "position_squared", "word_count_squared",
                "is_object_chunk", "is_attribute_chunk", "is_relation_chunk"]


@register("chunk_features", "C8 W6 W7 V11 (18 chunk features)", f"""
WITH {CHUNKS},
f0 AS (SELECT ch.*, g.generated_description AS gen,
         CAST(len(list_filter(regexp_split_to_array(ch.chunk_text, '[{PY_WS}]+'), lambda x: x <> '')) AS INTEGER) AS wc,
         len(list_filter(regexp_split_to_array(g.generated_description, '[{PY_WS}]+'), lambda x: x <> '')) AS gw,
         length(g.generated_description) AS gl
       FROM ch JOIN gen g USING (sample_id)),
f1 AS (SELECT *, CAST(count(*) OVER (PARTITION BY sample_id) AS INTEGER) AS n, max(wc) OVER (PARTITION BY sample_id) AS mw,
              CASE WHEN gl > 0 THEN "start" / gl ELSE 0.0 END AS rp FROM f0)
SELECT sample_id, chunk_idx, wc AS chunk_word_count, round(rp, 6)::DOUBLE AS chunk_relative_position,
  n AS total_chunks_in_image, round(CASE WHEN n > 1 THEN chunk_idx / n ELSE 0.0 END, 6)::DOUBLE AS chunk_position_normalized,
  CAST(chunk_idx = 0 AS INTEGER) AS is_first_chunk, CAST(chunk_idx = n - 1 AS INTEGER) AS is_last_chunk,
  CAST(chunk_idx > 0 AND chunk_idx < n - 1 AS INTEGER) AS is_middle_chunk,
  round(wc / greatest(1, mw), 6)::DOUBLE AS word_count_normalized, CAST(wc <= 3 AS INTEGER) AS is_short_chunk,
  CAST(wc >= 8 AS INTEGER) AS is_long_chunk, round(CASE WHEN gw > 0 THEN n / gw ELSE 0.0 END, 6)::DOUBLE AS chunks_density,
  round(CASE WHEN gl > 0 THEN length(chunk_text) / gl ELSE 0.0 END, 6)::DOUBLE AS chunk_length_ratio,
  round(rp * wc, 6)::DOUBLE AS position_length_interaction, round(rp * rp, 6)::DOUBLE AS position_squared,
  CAST(wc * wc AS INTEGER) AS word_count_squared, CAST(chunk_type = 'object' AS INTEGER) AS is_object_chunk,
  CAST(chunk_type = 'attribute' AS INTEGER) AS is_attribute_chunk,
  CAST(chunk_type = 'relation' AS INTEGER) AS is_relation_chunk
FROM f1""")
def chunk_features(spark, sf):
    g = labelling.prepare_generated(fixtures.generations(spark, sf))
    f = chunk_ops.chunk_features(g.samples)
    return rounded(f.select("sample_id", "chunk_idx", *FEATURE_COLS))


@register("truth_terms", "C9 C10 C11 U3 T8 (reference objects, attributes, relations per sample)", f"""
WITH {TEXTS}, {TRUTH}
SELECT sample_id, 'object' AS kind, NULL::VARCHAR AS category, obj AS term FROM gobj
UNION ALL SELECT sample_id, 'attribute', category, attr FROM gattr
UNION ALL SELECT sample_id, 'relation', NULL, rel FROM grel""")
def truth_terms(spark, sf):
    li = _inputs(spark, sf)
    o = li.gt_objects.select("sample_id", F.lit("object").alias("kind"), F.lit(None).cast("string").alias("category"),
                             F.col("obj").alias("term"))
    a = li.gt_attributes.select("sample_id", F.lit("attribute").alias("kind"), "category", F.col("attr").alias("term"))
    r = li.gt_relations.select("sample_id", F.lit("relation").alias("kind"), F.lit(None).cast("string").alias("category"),
                               F.col("rel").alias("term"))
    return o.unionByName(a).unionByName(r)


def _existence(spark, sf, kinds, fuzzy):
    """(sample_id, term, exists) of the distinct terms of the chunks of some kinds."""
    terms = F.flatten(F.transform(F.filter("chunks", kinds), matching.chunk_terms))
    d = matching.with_existing(_inputs(spark, sf).samples, terms, fuzzy)
    d = d.select("sample_id", "_exist", F.explode_outer("_terms").alias("term")).filter("term IS NOT NULL")
    return d.select("sample_id", "term", F.array_contains("_exist", F.col("term")).alias("exists"))


@register("object_existence_exact", "C5 J12 J13 (cascade without the fuzzy stage)", f"""
WITH {CHUNKS}, {TRUTH}, {EXISTS}
SELECT sample_id, term, "exists" FROM ex""")
def object_existence_exact(spark, sf):
    return _existence(spark, sf, lambda c: c["chunk_type"].isin("object", "attribute", "relation"), fuzzy=False)


@register("object_existence", "C5 T4 F4 (full cascade with the Ratcliff-Obershelp stage)")
def object_existence(spark, sf):
    return _existence(spark, sf, lambda c: c["chunk_type"] == "object", fuzzy=True)


LABELS_EXACT = f"""
WITH {CHUNKS}, {TRUTH}, {EXISTS},
ct AS (SELECT sample_id, chunk_idx, CASE WHEN chunk_type = 'object' THEN chunk_text ELSE object END AS term FROM ch
       WHERE chunk_type IN ('object', 'attribute')
       UNION ALL SELECT sample_id, chunk_idx, unnest(objects) FROM ch WHERE chunk_type = 'relation'),
ok AS (SELECT ct.sample_id, ct.chunk_idx, bool_and(ex."exists") AS object_ok FROM ct
       JOIN ex ON ex.sample_id = ct.sample_id AND ex.term = ct.term GROUP BY 1, 2),
st AS (SELECT sample_id, count(*) AS n_attr FROM gattr GROUP BY 1),
lab AS (
  SELECT ch.sample_id, ch.chunk_idx, ch.chunk_type, coalesce(ok.object_ok, false) AS object_ok,
    EXISTS (SELECT 1 FROM gattr g WHERE g.sample_id = ch.sample_id AND g.attr = lower({STRIP('ch.attribute')}))
    OR (lower({STRIP('ch.attribute')}) NOT IN (SELECT word FROM acat)
        AND NOT EXISTS (SELECT 1 FROM gattr g WHERE g.sample_id = ch.sample_id AND g.category = 'other')
        AND coalesce((SELECT n_attr FROM st WHERE st.sample_id = ch.sample_id), 0) = 0) AS attr_match,
    EXISTS (SELECT 1 FROM grel r WHERE r.sample_id = ch.sample_id AND r.rel = lower(ch.relation)) AS rel_match
  FROM ch LEFT JOIN ok ON ok.sample_id = ch.sample_id AND ok.chunk_idx = ch.chunk_idx),
labels AS (SELECT sample_id, chunk_idx, chunk_type, CASE
    WHEN NOT object_ok THEN 'CATEGORY_HALLUC'
    WHEN chunk_type = 'attribute' AND NOT attr_match THEN 'ATTRIBUTE_HALLUC'
    WHEN chunk_type = 'relation' AND NOT rel_match THEN 'RELATION_HALLUC'
    ELSE 'CORRECT' END AS chunk_label
  FROM lab)
"""


@register("chunk_labels_exact", "C6 C7 C12 (hierarchical labels without the fuzzy stage)",
          LABELS_EXACT + "SELECT sample_id, chunk_idx, chunk_label FROM labels")
def chunk_labels_exact(spark, sf):
    return labelling.label(_inputs(spark, sf), fuzzy=False, fields=("chunk_label",))


@register("chunk_labels", "C5 C6 C7 C12 T4 (hierarchical labels, full rules)")
def chunk_labels(spark, sf):
    return labelling.label(_inputs(spark, sf), fuzzy=True).select(
        "sample_id", "chunk_idx", "chunk_text", "chunk_type", "chunk_label")


@register("label_distribution", "A19 (label counts and shares, exact rules)", LABELS_EXACT + """
SELECT chunk_label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM labels
GROUP BY chunk_label""")
def label_distribution(spark, sf):
    from ..operators import report
    lab = labelling.label(_inputs(spark, sf), fuzzy=False)
    return rounded(report.class_distribution(lab, "chunk_label"))


def _explanations(spark, sf, fuzzy=True):
    return labelling.explained(_inputs(spark, sf), fuzzy)


def _explained(ex):
    return ex.select("sample_id", "chunk_idx", "chunk_text", "chunk_type", "chunk_label", "reasoning", F.array_join("gt_objects", ", ").alias("gt_objects"),
                     F.array_join("gt_attributes", ", ").alias("gt_attributes"), F.array_join("gt_relations", ", ").alias("gt_relations"))


@register("label_explanations", "C14 (reason text and reference sets of every chunk)")
def label_explanations(spark, sf):
    return _explained(_explanations(spark, sf))


def _examples(spark, sf, per_class, fuzzy):
    """The first rows of a label lie in its first ``per_class`` samples: these are found first, by their ids alone; then only their lines are read."""
    li = _inputs(spark, sf)
    of = F.explode_outer(F.array_distinct(F.transform("chunks", lambda c: c["chunk_label"]))).alias("chunk_label")
    first = matching.with_labels(li.samples, fuzzy).select("sample_id", of)
    first = first.withColumn("_rk", F.row_number().over(Window.partitionBy("chunk_label").orderBy("sample_id"))).filter(F.col("_rk") <= per_class)
    only = materialize(first.select("sample_id").distinct())  # per_class rows a label
    ex = labelling.explained(_inputs(spark, sf, only), fuzzy, only=only)
    w = Window.partitionBy("chunk_label").orderBy("sample_id", "chunk_idx")
    return _explained(ex.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= per_class))


@register("label_examples", "W12 (first examples per class, a top-k report)")
def label_examples(spark, sf, per_class: int = 50):
    return _examples(spark, sf, per_class, fuzzy=True)


EXPLAINED_EXACT = LABELS_EXACT + """,
gl AS (SELECT sample_id, string_agg(obj, ', ' ORDER BY obj) AS gt_objects FROM gobj GROUP BY 1),
al AS (SELECT sample_id, string_agg(category || ':' || attr, ', ' ORDER BY category || ':' || attr) AS gt_attributes FROM gattr GROUP BY 1),
rl AS (SELECT sample_id, string_agg(rel, ', ' ORDER BY rel) AS gt_relations FROM grel GROUP BY 1),
at0 AS (SELECT sample_id, chunk_idx, 1 AS k, CASE WHEN chunk_type = 'object' THEN chunk_text ELSE object END AS term FROM ch
        WHERE chunk_type IN ('object', 'attribute')
        UNION ALL SELECT sample_id, chunk_idx, unnest(range(1, len(objects) + 1)), unnest(objects) FROM ch WHERE chunk_type = 'relation'),
miss AS (SELECT at0.sample_id, at0.chunk_idx, string_agg(at0.term, ', ' ORDER BY k) AS missing FROM at0
         JOIN ex ON ex.sample_id = at0.sample_id AND ex.term = at0.term WHERE NOT ex."exists" GROUP BY 1, 2),
explained AS (SELECT ch.sample_id, ch.chunk_idx, ch.chunk_text, ch.chunk_type, l.chunk_label,
  CASE WHEN l.chunk_label = 'CATEGORY_HALLUC'
         THEN 'Not among the reference objects: ' || coalesce(missing, '') || '; reference objects: ' || coalesce(gt_objects, '')
       WHEN ch.chunk_type = 'attribute' THEN 'Object ''' || object || ''' exists; attribute ''' || attribute || ''' is '
         || CASE WHEN l.chunk_label = 'CORRECT' THEN 'correct' ELSE 'incorrect; reference attributes: ' || coalesce(gt_attributes, '') END
       WHEN ch.chunk_type = 'relation' THEN 'Objects exist: ' || array_to_string(objects, ', ') || '; relation ''' || relation || ''' is '
         || CASE WHEN l.chunk_label = 'CORRECT' THEN 'correct' ELSE 'incorrect; reference relations: ' || coalesce(gt_relations, '') END
       ELSE 'Object ''' || ch.chunk_text || ''' is among the reference objects' END AS reasoning,
  gt_objects, gt_attributes, gt_relations
  FROM ch JOIN labels l USING (sample_id, chunk_idx) LEFT JOIN miss USING (sample_id, chunk_idx)
  LEFT JOIN gl USING (sample_id) LEFT JOIN al USING (sample_id) LEFT JOIN rl USING (sample_id))
"""


@register("label_explanations_exact", "C14 (reasons and reference sets, labels without the fuzzy stage)", EXPLAINED_EXACT + "SELECT * FROM explained")
def label_explanations_exact(spark, sf):
    return _explained(_explanations(spark, sf, fuzzy=False))


@register("label_examples_exact", "W12 (first examples per class, labels without the fuzzy stage)", EXPLAINED_EXACT + """
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_label ORDER BY sample_id, chunk_idx) AS rk FROM explained) WHERE rk <= 50""")
def label_examples_exact(spark, sf, per_class: int = 50):
    return _examples(spark, sf, per_class, fuzzy=False)


# The longest block is found by listing substrings; each round opens the segments on both sides of it.
_BLOCK = """list_max(flatten(list_transform(range(1, length(s.x) + 1), lambda i: list_transform(range(1, length(s.x) - i + 2),
    lambda l: CASE WHEN contains(s.y, substr(s.x, i::INTEGER, l::INTEGER)) THEN {'l': l, 'i': -i} END))))"""
BLOCKS = f"""WITH RECURSIVE pairs AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part),
seg AS (
  SELECT a, b, s, {_BLOCK} AS m
  FROM (SELECT DISTINCT a, b, {{'x': lower(a), 'y': lower(b)}} AS s FROM pairs WHERE b IS NOT NULL)
  UNION ALL
  SELECT a, b, s, {_BLOCK} AS m
  FROM (SELECT a, b, unnest([{{'x': substr(s.x, 1, (-m.i - 1)::INTEGER), 'y': substr(s.y, 1, (hit - 1)::INTEGER)}},
                             {{'x': substr(s.x, (-m.i + m.l)::INTEGER), 'y': substr(s.y, (hit + m.l)::INTEGER)}}]) AS s
        FROM (SELECT *, strpos(s.y, substr(s.x, (-m.i)::INTEGER, m.l::INTEGER)) AS hit FROM seg WHERE m.l > 0)))
SELECT p_partkey, round(2.0 * total / (length(a) + length(b)), 6)::DOUBLE AS ratio
FROM pairs JOIN (SELECT a, b, coalesce(sum(m.l), 0) AS total FROM seg GROUP BY a, b) USING (a, b)"""


@register("similarity_ratio", "T4 F4 (Ratcliff-Obershelp ratio of each part's name and the next one's)", BLOCKS)
def similarity_ratio(spark, sf):
    p = tables.table(spark, sf, "part").select("p_partkey", "p_name")
    # part keys are dense, so the next part is the one with the next key
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    scored = both.select("p_name", "b").distinct().withColumn("ratio", F.round(similarity(F.col("p_name"), F.col("b")), 6))
    return both.join(scored, ["p_name", "b"]).select("p_partkey", "ratio")

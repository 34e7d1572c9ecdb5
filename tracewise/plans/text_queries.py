"""Queries over free text, dialogues and sample catalogs.

(T1-T3, T5-T8, S17, S4, W4, P1-P5, P13, P14, P16, P17, A1, O1)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog, text
from ..functions.text import PY_WORD, PY_WS
from ..operators import samples
from ..sources import tables
from .registry import register, rounded

WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '[{PY_WS}]+'), lambda w: w <> '')"


def _strip_sql(x):
    return f"regexp_replace({x}, '^[{PY_WS}]+|[{PY_WS}]+$', '', 'g')"


def _docs(spark, sf, *cols):
    return tables.table(spark, sf, "documents").select("doc_id", *cols)


@register("text_truncate", "T1 (first 128 words)", f"""
SELECT doc_id, array_to_string(list_slice({WORDS}, 1, 128), ' ') AS truncated FROM documents""")
def text_truncate(spark, sf):
    d = _docs(spark, sf, "text")
    return d.select("doc_id", text.truncate_words(F.col("text"), 128).alias("truncated"))


@register("text_normalize", "T3 (lower, strip non-word, strip)", f"""
SELECT doc_id, {_strip_sql(f"regexp_replace(lower(text), '[^{PY_WORD}{PY_WS}]', '', 'g')")} AS normalized
FROM documents""")
def text_normalize(spark, sf):
    return _docs(spark, sf, "text").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@register("text_sanitize", "T2 S17 (newline sanitising for one-line-per-row sinks)", f"""
SELECT doc_id, regexp_replace(text, '[\\n\\r]', ' ', 'g') AS line,
       {_strip_sql("regexp_replace(text, '[\\n\\r]', ' ', 'g')")} AS line_stripped
FROM documents""")
def text_sanitize(spark, sf):
    t = F.col("text")
    return _docs(spark, sf, "text").select("doc_id", text.sanitize_lines(t).alias("line"),
                                           text.sanitize_lines(t, True).alias("line_stripped"))


@register("text_repetition", "T5 W10 (features 71-73 on whitespace tokens)", f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS u,
        len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS nb FROM w)
SELECT doc_id,
  round(CASE WHEN n > 0 THEN 1.0 - u / n ELSE 0.0 END, 6)::DOUBLE AS feature_71,
  round(CASE WHEN n > 1 THEN 1.0 - nb / (n - 1) ELSE 0.0 END, 6)::DOUBLE AS feature_72,
  round(CASE WHEN n > 0 THEN u / n ELSE 0.0 END, 6)::DOUBLE AS feature_73
FROM x""")
def text_repetition(spark, sf):
    names = ("feature_71", "feature_72", "feature_73")
    return rounded(text.with_repetition(_docs(spark, sf, "text"), "text", names).select("doc_id", *names))


@register("text_counts", "T6 (word and character counts, ratio)", f"""
WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(length(text) AS INTEGER) AS n_chars,
       round(CASE WHEN length(text) > 0 THEN len(w) / length(text) ELSE 0.0 END, 6)::DOUBLE AS words_per_char
FROM w""")
def text_counts(spark, sf):
    d = _docs(spark, sf, "text").select("doc_id", F.size(text.words(F.col("text"))).alias("n_words"),
                                        F.length("text").alias("n_chars"))
    return rounded(d.select("doc_id", "n_words", "n_chars", F.when(F.col("n_chars") > 0, F.col("n_words") / F.col(
        "n_chars")).otherwise(F.lit(0.0)).alias("words_per_char")))


DIALOGUE_SQL = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
s AS (SELECT conv_id, arg_min(text, turn) AS story0 FROM c WHERE role = 'system' GROUP BY conv_id),
qa AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM c q JOIN c a
       ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'),
g AS (SELECT *, CASE WHEN suffix(' Q: ' || question || ' A: ' || answer, '.')
                     THEN ' Q: ' || question || ' A: ' || answer
                     ELSE ' Q: ' || question || ' A: ' || answer || '.' END AS seg FROM qa),
r AS (SELECT conv_id, turn, question, answer,
        CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS q_idx,
        coalesce(string_agg(seg, '') OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev FROM g),
d AS (SELECT r.conv_id, r.turn, r.q_idx, CAST(r.conv_id AS VARCHAR) || '_' || CAST(r.q_idx AS VARCHAR) AS id,
        coalesce(s.story0, '') || r.prev AS story, r.question, r.answer
      FROM r LEFT JOIN s USING (conv_id))"""


@register("dialogue_pairs", "S4 W4 (CoQA-style running story)", DIALOGUE_SQL + "\nSELECT * FROM d")
def dialogue_pairs(spark, sf):
    return samples.dialogue_pairs(tables.table(spark, sf, "conversations"))


# --- fixed values: the coqa template of ``samples.PROMPTS``, as SQL text -------
@register("dialogue_prompts", "P5 (coqa template over dialogues)", DIALOGUE_SQL + """
SELECT id, 'Answer the question concisely based on the context: ' || chr(10) || ' ' || story || ' ' || chr(10)
           || ' Q: ' || question || ' A:' AS prompt FROM d""")
def dialogue_prompts(spark, sf):
    d = samples.dialogue_pairs(tables.table(spark, sf, "conversations"))
    return d.select("id", samples.prompt("coqa", set(d.columns)).alias("prompt"))


QA_DATASETS = ["truthfulqa", "triviaqa", "tydiqa", "coqa", "haluevaldia", "haluevalqa", "haluevalsum", "other"]


def _qa_samples(spark, sf):
    """documents as QA rows: dataset by doc_id % 8, question = the whole text."""
    d = _docs(spark, sf, "text", "source", "lang")
    ds = F.element_at(F.array(*[F.lit(x) for x in QA_DATASETS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select("doc_id", ds.alias("dataset"), F.col("text").alias("question"),
                    F.col("text").alias("context"), F.col("source").alias("knowledge"),
                    F.col("lang").alias("dialogue_history"), F.col("text").alias("document"),
                    F.col("text").alias("story"))


# --- fixed values: the prompt templates of ``samples.PROMPTS``, as SQL text ----
@register("qa_prompts", "P5 (all seven templates, unknown dataset -> question)", f"""
WITH d AS (SELECT doc_id, ['truthfulqa','triviaqa','tydiqa','coqa','haluevaldia','haluevalqa','haluevalsum','other']
             [doc_id % 8 + 1] AS dataset,
             text AS question, text AS context, source AS knowledge,
             lang AS dialogue_history, text AS document, text AS story FROM documents)
SELECT doc_id, dataset, CASE dataset
  WHEN 'truthfulqa' THEN 'Answer the question concisely. Q: ' || question || ' A:'
  WHEN 'triviaqa' THEN 'Answer the question concisely. Q: ' || question || ' A:'
  WHEN 'tydiqa' THEN 'Answer the question concisely based on the context: ' || chr(10) || ' ' || context || ' '
                     || chr(10) || ' Q: ' || question || ' A:'
  WHEN 'coqa' THEN 'Answer the question concisely based on the context: ' || chr(10) || ' ' || story || ' '
                   || chr(10) || ' Q: ' || question || ' A:'
  WHEN 'haluevaldia' THEN 'You are an assistant that answers questions concisely and accurately. Use the knowledge '
       || 'and conversation to respond naturally to the most recent message.' || chr(10) || 'Knowledge: ' || knowledge
       || '.' || chr(10) || 'Conversations: ' || dialogue_history || '.' || chr(10) || 'Your Response:'
  WHEN 'haluevalqa' THEN 'Answer the question concisely based on the context: ' || chr(10) || ' ' || knowledge || ' '
                         || chr(10) || ' Q: ' || question || ' A:'
  WHEN 'haluevalsum' THEN document || ' ' || chr(10) || ' Please summarize the above article concisely. A:'
  ELSE question END AS prompt
FROM d""")
def qa_prompts(spark, sf):
    d = _qa_samples(spark, sf)
    return d.select("doc_id", "dataset", samples.prompt(F.col("dataset"), set(d.columns)).alias("prompt"))


@register("sample_names", "P4 O1 (dataset = lang, index by doc_id, first 1000 per dataset)", """
WITH d AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS idx
           FROM documents)
SELECT doc_id, lang, idx, lang || '_sample_' || CAST(idx AS VARCHAR) AS name,
       lang || '_sample_' || CAST(idx AS VARCHAR) || '.txt' AS filename FROM d WHERE idx < 1000""")
def sample_names(spark, sf):
    d = _docs(spark, sf, "lang")
    n = samples.name_samples(d, F.col("lang"), ["doc_id"], partition="lang")
    return samples.first_n(n, "idx", 1000).select("doc_id", "lang", "idx", "name", "filename")


@register("english_filter_then_name", "P2 S9 (filter before index: contains(source,'1'))", """
WITH f AS (SELECT doc_id, source FROM documents WHERE contains(source, '1'))
SELECT doc_id, source, 'tydiqa_sample_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS name FROM f""")
def english_filter_then_name(spark, sf):
    d = samples.english_only(_docs(spark, sf, "source"), "source", needle="1")
    return samples.name_samples(d, "tydiqa", ["doc_id"]).select("doc_id", "source", "name")


@register("dedupe_first_per_key", "A1 S8 (keep first row per key in order)", """
SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang,
       arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source""")
def dedupe_first_per_key(spark, sf):
    d = _docs(spark, sf, "source", "lang", "n_chars")
    return samples.first_per_key(d, "source", "doc_id").select("source", "doc_id", "lang", "n_chars")


MODEL_IDS = ["llava-hf/llava-1.5-7b-hf", "meta-llama/Llama-3.2-11B-Vision-Instruct",
             "Salesforce/instructblip-vicuna-7b", "microsoft/kosmos-2-patch14-224",
             "microsoft/Phi-3.5-vision-instruct", "nlpconnect/vit-gpt2-image-captioning",
             "HuggingFaceTB/SmolVLM-Instruct", "HuggingFaceTB/SmolVLM-Synthetic",
             "Qwen/Qwen2.5-VL-7B-Instruct", "google/paligemma-3b-mix-224", "HuggingFaceTB/SmolVLM-256M",
             "mistralai/Mistral-7B"]
_IDS_SQL = "[" + ", ".join(f"'{m}'" for m in MODEL_IDS) + "]"


@register("model_rules", "P1 P3 P17 (model type, layer start, output name per part)", f"""
WITH p AS (SELECT p_partkey, p_type, {_IDS_SQL}[p_partkey % {len(MODEL_IDS)} + 1] || '-' || p_type AS model_id
           FROM part),
t AS (SELECT p_partkey, p_type, model_id, lower(model_id) AS s FROM p),
m AS (SELECT p_partkey, p_type, model_id, CASE
  WHEN contains(s, 'llava') THEN 'llava'
  WHEN (contains(s, 'llama') AND contains(s, 'vision')) OR contains(s, 'mllama') THEN 'mllama'
  WHEN contains(s, 'instructblip') OR contains(s, 'blip') THEN 'instructblip'
  WHEN contains(s, 'kosmos') THEN 'kosmos'
  WHEN contains(s, 'phi') AND (contains(s, 'vision') OR contains(s, '3.5')) THEN 'phi'
  WHEN contains(s, 'vit') AND (contains(s, 'gpt2') OR contains(s, 'captioning')) THEN 'vit'
  WHEN contains(s, 'smolvlm') AND contains(s, 'instruct') THEN 'smolvlm2b'
  WHEN contains(s, 'smolvlm') AND contains(s, 'synthetic') THEN 'smolvlmsynthetic'
  WHEN contains(s, 'qwen') AND (contains(s, 'vl') OR contains(s, 'vision')) THEN 'qwen'
  WHEN contains(s, 'paligemma') THEN 'paligemma'
  WHEN contains(s, 'huggingfacetb/smolvlm') THEN 'smolvlm2b'
  ELSE 'llava' END AS model_type FROM t)
SELECT p_partkey, model_id, model_type,
  CAST(coalesce(MAP {{'llava': 24, 'mllama': 40, 'instructblip': 51, 'kosmos': 24, 'phi': 24, 'vit': 0,
    'smolvlm2b': 0, 'smolvlmsynthetic': 0, 'qwen': 32, 'paligemma': 27, 'llm': 0}}[model_type], 24) AS INTEGER)
    AS layer_start,
  split_part(model_id, '/', -1) || '_' || p_type AS output_name
FROM m""")
def model_rules(spark, sf):
    p = tables.table(spark, sf, "part").select("p_partkey", "p_type")
    ids = F.array(*[F.lit(m) for m in MODEL_IDS])
    mid = F.concat(F.element_at(ids, (F.col("p_partkey") % len(MODEL_IDS) + 1).cast("int")), F.lit("-"), F.col("p_type"))
    p = p.withColumn("model_id", mid).withColumn("model_type", catalog.model_type(F.col("model_id")))
    return p.select("p_partkey", "model_id", "model_type",
                    catalog.layer_start(F.col("model_type")).cast("int").alias("layer_start"),
                    catalog.output_name(F.col("model_id"), F.col("p_type")).alias("output_name"))


@register("context_and_presence", "P13 P14 (drop empty text, Q/A sentence context)", f"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN NULL
             ELSE text END AS question FROM documents)
SELECT doc_id, CASE WHEN question IS NOT NULL THEN 'Q: ' || question || ' A: ' || text ELSE text END AS context
FROM d WHERE text IS NOT NULL AND text <> ''""")
def context_and_presence(spark, sf):
    d = _docs(spark, sf, "text").withColumn(
        "question", F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("text")))
    d = samples.text_present(d, "text")
    return d.select("doc_id", samples.sentence_context(F.col("question"), F.col("text")).alias("context"))

"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say them.

Each query applies its operator with production parameters to its whole
table and keeps the contract's digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewise.sources.tables import table

from . import (
    chunk_reuse,
    decontamination,
    divergence,
    language_id,
    language_model,
    prefix_trie,
    quality,
    reply_trees,
    simhash,
    substring_dedup,
    token_counts,
    token_files,
    warc,
)
from .chat_template import CLOSE, CONTROL, OPEN, ROLE_CLOSE, ROLE_END, ROLE_OPEN

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the driver and the executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored_documents(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=2)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return reply_trees.conversation_digests(reply_trees.format_conversations(conversations))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[k:k + 12] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM iw),
dw AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _op7_sql() -> str:
    ratio = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
             "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    x = {k: f"({a} * 1024) // greatest({b}, 1)" for k, (a, b) in ratio.items()}
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS signal, {x[k]} AS x FROM s WHERE n_words > 0" for k in x)
    quantile = lambda k, of, name: f"min(CASE WHEN {of} * upto >= {k} * total THEN value END) AS {name}"

    def fences(tag: str, by: str) -> str:
        return f"""{tag} AS (
  SELECT {by}signal, docs, least(q1 - {quality.REACH} * (q3 - q1), bottom) AS low, greatest(q3 + {quality.REACH} * (q3 - q1), top) AS high
  FROM (SELECT {by}signal, max(total) AS docs, {quantile(1, 4, "q1")}, {quantile(3, 4, "q3")},
               {quantile(1, quality.TAIL, "bottom")}, {quantile(quality.TAIL - 1, quality.TAIL, "top")}
        FROM (SELECT {by}signal, value, sum(n) OVER (PARTITION BY {by}signal ORDER BY value) AS upto,
                     sum(n) OVER (PARTITION BY {by}signal) AS total
              FROM (SELECT {by}signal, value, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY {by}signal))"""

    pick = lambda e: f"CASE WHEN a.docs >= {quality.MIN_DOCS} THEN a.{e} WHEN b.docs >= {quality.MIN_DOCS} THEN b.{e} ELSE c.{e} END AS {e}"
    ends = {"low": "low", "high": "high + (1::BIGINT << greatest(length(bin(high::BIGINT)) - 8, 0)) - 1"}  # the last value of the fence's cell
    limits = ", ".join(f"max(CASE WHEN signal = '{n}' THEN {v} END) AS {n}_{e}" for n in x for e, v in ends.items())
    within = " AND ".join(f"{x[n]} BETWEEN {n}_low AND {n}_high" for n in x)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, w[k:k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(k, k + 3)) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
      GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE translate(x, {_WHITE}, '') <> '' GROUP BY doc_id),
s AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(t, {_WHITE}, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
             coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
k AS (SELECT lang, source, signal, x >> greatest(length(bin(x)) - 8, 0) << greatest(length(bin(x)) - 8, 0) AS value, count(*) AS n
      FROM ({each}) GROUP BY ALL),
{fences("a", "lang, source, ")}, {fences("b", "lang, ")}, {fences("c", "")},
f AS (SELECT a.lang, a.source, signal, {pick("low")}, {pick("high")} FROM a JOIN b USING (lang, signal) JOIN c USING (signal)),
t AS (SELECT lang, source, {limits} FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({within}, false) AS kept
FROM s LEFT JOIN t USING (lang, source)
"""


_CRC_STEP = "xor({0} >> 1, 3988292384 * ({0} & 1))"


def _crc32(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of an ASCII text; needs the byte table ``crc_t`` of ``_crc_table`` in scope."""
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INTEGER, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295)"


def _crc_table() -> str:
    steps = "SELECT i, i::BIGINT AS c FROM range(256) r(i)"
    for _ in range(8):
        steps = f"SELECT i, {_CRC_STEP.format('c')} AS c FROM ({steps})"
    return f"crc AS (SELECT list(c ORDER BY i) AS crc_t FROM ({steps}))"


def _op11_sql() -> str:
    doubled = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in ["\\", *CONTROL])  # control strings never overlap
    escaped = lambda x: f"(length({x}) + {doubled.replace('(x', '(' + x)})"
    marks = " ".join(f"WHEN '{r}' THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
s AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST) AS all_turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
             sum({escaped('text')} + CASE role {marks} ELSE {escaped('role')} + {len(ROLE_OPEN + ROLE_END + ROLE_CLOSE)} END) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(all_turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars
FROM s
"""


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS k FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = f"""
WITH {_crc_table()},
r AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, strlen(coalesce(text, '')) AS n,
             sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_crc32("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM r), crc),
turns AS (SELECT ids.c, r.k, r.s, r.n FROM ids JOIN r ON r.c = ids.c - ids.c % 5 AND r.k <= ids.h
          UNION ALL SELECT ids.c, r.k + 100, r.s, r.n FROM ids JOIN r ON r.c = ids.c AND r.k > ids.h),
seqs AS (SELECT ids.c, list(s ORDER BY k) FILTER (s IS NOT NULL) AS s, list(n ORDER BY k) FILTER (n IS NOT NULL) AS n
         FROM ids LEFT JOIN turns USING (c) GROUP BY ids.c),
pre AS (SELECT c, d, array_to_string(coalesce(s[:d], []), ',') AS key, array_to_string(coalesce(s[:d - 1], []), ',') AS up, n[d] AS n,
               d = coalesce(len(s), 0) AS ends
        FROM (SELECT c, s, n, unnest(range(0, coalesce(len(s), 0) + 1)) AS d FROM seqs)),
nodes AS (SELECT key, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
          FROM pre GROUP BY key, d),
kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
each AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
below AS (SELECT p.key, count(*) FILTER (e.n_children = 0) AS n_leaves, coalesce(sum((e.n_convs - 1) * e.n) FILTER (e.d > 0), 0) AS saved_tokens
          FROM each e JOIN pre m ON m.c = e.conv_id AND m.d = e.d JOIN pre p ON p.c = e.conv_id AND p.d <= e.d GROUP BY p.key)
SELECT e.conv_id, e.d::BIGINT AS depth, u.conv_id AS parent_conv_id, e.n_convs::BIGINT AS n_convs, e.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
FROM each e JOIN below b USING (key) LEFT JOIN each u ON e.d > 0 AND u.key = e.up
"""


def queries() -> dict[str, Query]:
    every = [op1_decontamination, op2_substring_dedup, op3_simhash_near_dedup, op4_language_id, op5_lm_scoring, op6_warc,
             op7_quality_rules, op8_bpe_encode_decode, op9_token_counts, op10_token_id_output,
             op11_chat_formatting, op12_source_divergence, op13_conversation_prefix_trie]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op6_warc": OP6_SQL, "op7_quality_rules": _op7_sql(),
            "op11_chat_formatting": _op11_sql(), "op12_source_divergence": OP12_SQL, "op13_conversation_prefix_trie": OP13_SQL}

"""Semantic chunks of generated text and their features.

Two forms of the same rules.  ``with_chunks`` takes texts, tags them by the
default tagger and keeps their chunks as an array in the row; it shuffles nothing.
``extract_chunks`` takes any tagger's ``tokens`` table keyed by ``sample_id``: every join is keyed by
(sample_id, token index), every window is per sample over its chunks (one text's worth).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import strip, words
from . import tagger

KEY = "sample_id"
NOUNS = ("NOUN", "PROPN")
TYPE_RANK = {"object": 0, "attribute": 1, "relation": 2}
CHUNK_COLS = ["chunk_text", "chunk_type", "type_rank", "tok_key", "start", "end", "attribute", "object",
              "relation", "objects"]


def object_chunks(tokens: DataFrame) -> DataFrame:
    """Non-stop nouns."""
    t = tokens.filter(F.col("pos").isin(*NOUNS) & ~F.col("is_stop"))
    return t.select(KEY, strip(F.col("text")).alias("chunk_text"), F.lit("object").alias("chunk_type"),
                    F.lit(0).alias("type_rank"), F.col("tok_idx").alias("tok_key"),
                    F.col("char_start").alias("start"), F.col("char_end").alias("end"),
                    F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("object"),
                    F.lit(None).cast("string").alias("relation"),
                    F.lit(None).cast("array<string>").alias("objects"))


def attribute_chunks(tokens: DataFrame) -> DataFrame:
    """Adjective + its noun head: self-join on (sample, head_idx = tok_idx)."""
    a = tokens.filter(F.col("pos") == "ADJ").alias("a")
    h = tokens.filter(F.col("pos").isin(*NOUNS)).alias("h")
    j = a.join(h, (F.col(f"a.{KEY}") == F.col(f"h.{KEY}")) & (F.col("a.head_idx") == F.col("h.tok_idx")))
    return j.select(F.col(f"a.{KEY}").alias(KEY),
                    F.concat(F.col("a.text"), F.lit(" "), F.col("h.text")).alias("chunk_text"),
                    F.lit("attribute").alias("chunk_type"), F.lit(1).alias("type_rank"),
                    F.col("a.tok_idx").alias("tok_key"), F.col("a.char_start").alias("start"),
                    F.col("h.char_end").alias("end"), F.col("a.text").alias("attribute"),
                    F.col("h.text").alias("object"), F.lit(None).cast("string").alias("relation"),
                    F.lit(None).cast("array<string>").alias("objects"))


def relation_chunks(tokens: DataFrame) -> DataFrame:
    """Preposition / agent / verb heads with at least two noun children.

    Text ``child0 head child1``; objects = all noun children in token order;
    start / end = min child start / max child end.
    """
    r = tokens.filter(F.col("dep").isin("prep", "agent") | (F.col("pos") == "VERB")).alias("r")
    c = tokens.filter(F.col("pos").isin(*NOUNS) & (F.col("head_idx") != F.col("tok_idx"))).alias("c")
    j = r.join(c, (F.col(f"r.{KEY}") == F.col(f"c.{KEY}")) & (F.col("c.head_idx") == F.col("r.tok_idx")))
    g = j.groupBy(F.col(f"r.{KEY}").alias(KEY), F.col("r.tok_idx").alias("tok_key"), F.col("r.text").alias("relation")
                  ).agg(F.array_sort(F.collect_list(F.struct(F.col("c.tok_idx").alias("i"),
                                                             F.col("c.text").alias("t")))).alias("_kids"),
                        F.min("c.char_start").alias("start"), F.max("c.char_end").alias("end"))
    g = g.filter(F.size("_kids") >= 2)
    objs = F.transform("_kids", lambda x: x["t"])
    return g.select(KEY, F.concat_ws(" ", F.get(objs, 0), F.col("relation"), F.get(objs, 1)).alias("chunk_text"),
                    F.lit("relation").alias("chunk_type"), F.lit(2).alias("type_rank"), "tok_key", "start", "end",
                    F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("object"),
                    "relation", objs.alias("objects"))


def extract_chunks(tokens: DataFrame, texts: DataFrame, text_col: str = "generated_description") -> DataFrame:
    """All chunks, de-duplicated and ordered, with a default chunk.

    * union of the three kinds (object -> attribute -> relation order);
    * keep the first chunk per case-insensitive text, dropping texts of
      two or fewer characters (a group-by ``min`` over (type, token));
    * ``chunk_idx`` by (start, type, token) within the sample;
    * a sample with no chunk gets one object chunk: the whole text at 0.

    The union is hash-partitioned by sample once; the de-duplication and the
    ordering window reuse that partitioning (a sample is one text, so no
    group is larger than one input row).  Every text also contributes a
    default candidate that sorts after all real chunks and is kept only when
    its sample has none, which avoids an anti-join.
    """
    u = object_chunks(tokens).unionByName(attribute_chunks(tokens)).unionByName(relation_chunks(tokens))
    u = u.filter(F.length(strip(F.col("chunk_text"))) > 2).repartition(KEY)
    first = u.groupBy(KEY, F.lower("chunk_text").alias("_lt")).agg(
        F.min(F.struct("type_rank", "tok_key", *[c for c in CHUNK_COLS if c not in ("type_rank", "tok_key")])
              ).alias("_c"))
    ch = first.select(KEY, *[F.col(f"_c.{c}").alias(c) for c in CHUNK_COLS], F.lit(False).alias("_dflt"))
    t = texts.select(KEY, F.col(text_col).alias("_gen")).filter(F.col("_gen").isNotNull() & (F.col("_gen") != ""))
    default = t.select(
        KEY, F.col("_gen").alias("chunk_text"), F.lit("object").alias("chunk_type"), F.lit(0).alias("type_rank"),
        F.lit(-1).alias("tok_key"), F.lit(0).alias("start"), F.length("_gen").alias("end"),
        F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("object"),
        F.lit(None).cast("string").alias("relation"), F.lit(None).cast("array<string>").alias("objects"),
        F.lit(True).alias("_dflt"))
    ch = ch.unionByName(default)
    sort_start = F.when(F.col("_dflt"), F.lit(2 ** 31 - 1)).otherwise(F.col("start"))
    w = Window.partitionBy(KEY).orderBy(sort_start, "type_rank", "tok_key")
    real = F.count(F.when(~F.col("_dflt"), F.lit(1))).over(Window.partitionBy(KEY))
    ch = ch.withColumn("chunk_idx", (F.row_number().over(w) - 1).cast("int")).withColumn("_real", real)
    return ch.filter(~F.col("_dflt") | (F.col("_real") == 0)).drop("_dflt", "_real")


CHUNK_TYPE = ArrayType(StructType([StructField(*f) for f in (
    ("start", IntegerType()), ("type_rank", IntegerType()), ("tok_key", IntegerType()), ("chunk_text", StringType()), ("chunk_type", StringType()),
    ("end", IntegerType()), ("attribute", StringType()), ("object", StringType()), ("relation", StringType()), ("objects", ArrayType(StringType())))]))
_KIND_NAMES = pa.array(["object", "attribute", "relation"])


def chunk_run(texts: list[str], linked: np.ndarray) -> pa.Array:
    """The chunks of some texts, as one list per text."""
    t = tagger.tokens_of(texts)
    at = np.arange(len(t.word))
    noun, adjective = t.are(lambda w: w.pos in NOUNS), t.are(lambda w: w.pos == "ADJ")
    bound = linked[t.row]
    o = np.flatnonzero(noun & ~t.are(lambda w: w.is_stop) & t.are(lambda w: len(w.text) > 2))
    a = np.flatnonzero(adjective & noun[t.head] & bound)
    # the children of each head side by side, in token order
    kids = np.flatnonzero(noun & (t.head != at) & bound)
    kids = kids[t.are(lambda w: w.pos in ("ADP", "VERB"))[t.head[kids]]]
    kids = kids[np.argsort(t.head[kids], kind="stable")]
    r, first, many = np.unique(t.head[kids], return_index=True, return_counts=True)
    r, first, many = r[many >= 2], first[many >= 2], many[many >= 2]
    n_kids = np.concatenate([[0], np.cumsum(many)])
    every = kids[np.repeat(first - n_kids[:-1], many) + np.arange(n_kids[-1])]
    shown = pa.array([w.text for w in t.words], pa.string())
    text = lambda i: shown.take(pa.array(t.word[i]))
    nulls = lambda n: pa.nulls(n, pa.string())
    joined = pa.compute.binary_join_element_wise
    own_a, led, own_r = text(a), text(t.head[a]), text(r)
    one, two = kids[first], kids[first + 1] if len(first) else first
    # texts without any chunk get one: all of it
    some = np.zeros(len(texts), bool)
    some[t.row[np.concatenate([o, a, r])]] = True
    d = np.flatnonzero(~some)
    chunk_text = pa.concat_arrays([text(o), joined(own_a, led, " "), joined(text(one), own_r, text(two), " "), pa.array([texts[i] for i in d.tolist()], pa.string())])
    size = [len(o), len(a), len(r), len(d)]
    rank = np.repeat([0, 1, 2, 0], size)
    row = np.concatenate([t.row[o], t.row[a], t.row[r], d])
    key = np.concatenate([t.place[o], t.place[a], t.place[r], np.full(len(d), -1)])
    start = np.concatenate([t.start[o], t.start[a], t.start[one], np.zeros(len(d), np.int64)])
    end = np.concatenate([t.end[o], t.end[t.head[a]], t.end[every[n_kids[1:] - 1]] if len(r) else r, [len(texts[i]) for i in d.tolist()]]).astype(np.int64)
    # the first of a text's chunks with equal text but for case
    coded = chunk_text.dictionary_encode()
    low = pa.array([x.lower() for x in coded.dictionary.to_pylist()], pa.string()).dictionary_encode().indices.to_numpy()[coded.indices.to_numpy()]
    order = np.lexsort((key, rank, low, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(low[order]) != 0)
    kept = order[fresh]
    kept = kept[np.lexsort((key[kept], rank[kept], start[kept], row[kept]))]
    words = pa.ListArray.from_arrays(pa.array(n_kids, pa.int32()), text(every))
    fields = {"start": pa.array(start, pa.int32()), "type_rank": pa.array(rank, pa.int32()), "tok_key": pa.array(key, pa.int32()), "chunk_text": chunk_text,
              "chunk_type": _KIND_NAMES.take(pa.array(rank)), "end": pa.array(end, pa.int32()),
              "attribute": pa.concat_arrays([nulls(size[0]), own_a, nulls(size[2] + size[3])]), "object": pa.concat_arrays([nulls(size[0]), led, nulls(size[2] + size[3])]),
              "relation": pa.concat_arrays([nulls(size[0] + size[1]), own_r, nulls(size[3])]),
              "objects": pa.concat_arrays([pa.nulls(size[0] + size[1], words.type), words, pa.nulls(size[3], words.type)])}
    which = pa.array(kept)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([x.take(which) for x in fields.values()], list(fields)))


@F.arrow_udf(CHUNK_TYPE)
def _chunks_of(texts: pa.Array, linked: pa.Array) -> pa.Array:
    linked = linked.to_numpy(zero_copy_only=False)
    runs = tagger.runs(pa.compute.binary_length(texts))
    found = [chunk_run([t or "" for t in texts.slice(a, b - a).to_pylist()], linked[a:b]) for a, b in runs]
    return pa.concat_arrays(found or [chunk_run([], linked)])


def with_chunks(df: DataFrame, text_col: str = "generated_description", out: str = "chunks") -> DataFrame:
    """``extract_chunks`` for texts tagged by the default tagger: an array of chunks per row, in order.

    A batch of texts is tagged and cut at once, by running sums, extremes and sorts over all its tokens;
    no row leaves its task.  The rules are those of ``extract_chunks``: without a sample id nothing joins a token to its head.
    """
    # declared nondeterministic (it is not), so that Spark computes it once and copies it into no later expression
    return df.withColumn(out, _chunks_of.asNondeterministic()(F.col(text_col), F.col(KEY).isNotNull()))


def feature_arrays(chunks: pa.ListArray, texts: list[str]) -> dict[str, pa.Array]:
    """The 18 numbers of ``chunk_features`` for the chunks of some texts, as doubles."""
    n = pa.compute.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
    c, starts = chunks.flatten(), np.cumsum(n) - n
    own = lambda a: np.repeat(a, n)
    total, i = own(n), np.arange(n.sum()) - own(starts)
    coded = c.field("chunk_text").dictionary_encode()
    kinds, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    count = np.array([len(t.split()) for t in kinds] or [0], np.int64)[code]
    length = np.array([len(t) for t in kinds] or [0], np.int64)[code]
    most = np.zeros(len(n), np.int64)
    most[n > 0] = np.maximum.reduceat(count, starts[n > 0]) if len(count) else 0
    chars, in_text = own(np.array([len(t) for t in texts], np.int64)), own(np.array([len(t.split()) for t in texts], np.int64))
    part = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    place = part(c.field("start").to_numpy(zero_copy_only=False).astype(np.int64), chars)
    kind = c.field("chunk_type")
    out = {"chunk_word_count": count, "chunk_relative_position": place, "total_chunks_in_image": total, "chunk_position_normalized": np.where(total > 1, i / total, 0.0),
           "is_first_chunk": i == 0, "is_last_chunk": i == total - 1, "is_middle_chunk": (i > 0) & (i < total - 1), "word_count_normalized": count / np.maximum(own(most), 1),
           "is_short_chunk": count <= 3, "is_long_chunk": count >= 8, "chunks_density": part(total, in_text), "chunk_length_ratio": part(length, chars),
           "position_length_interaction": place * count, "position_squared": place * place, "word_count_squared": count * count}
    out |= {f"is_{k}_chunk": pa.compute.equal(kind, k).to_numpy(zero_copy_only=False) for k in ("object", "attribute", "relation")}
    return {k: pa.array(np.asarray(v, np.float64)) for k, v in out.items()}


def chunk_rows(df: DataFrame, chunks: str = "chunks", keep: tuple = ()) -> DataFrame:
    """A row per chunk of an array column, with its place as ``chunk_idx``."""
    # an outer generator: below any other Spark computes the array once more to see that it is not empty
    return df.select(KEY, *keep, F.posexplode_outer(chunks).alias("chunk_idx", "_c")).filter("chunk_idx IS NOT NULL").select(KEY, *keep, "chunk_idx", "_c.*")


def chunk_arrays(chunks: DataFrame) -> DataFrame:
    """(sample, chunks): the rows of ``extract_chunks`` as one array per sample."""
    fields = ["start", "type_rank", "tok_key", "chunk_text", "chunk_type", "end", "attribute", "object", "relation", "objects"]
    every = F.sort_array(F.collect_list(F.struct("chunk_idx", F.struct(*fields).alias("c"))))
    return chunks.groupBy(KEY).agg(F.transform(every, lambda x: x["c"]).alias("chunks"))


def chunk_features(samples: DataFrame, text_col: str = "generated_description", keep: tuple = ()) -> DataFrame:
    """The 18 chunk features (C8, W6, W7, V11) of ``samples``: a text and the array of its chunks per row."""
    words_n = lambda t: F.size(words(t)).cast("int")
    per = samples.select(KEY, *keep, "chunks", F.length(text_col).alias("_len"), words_n(F.col(text_col)).alias("_words"), F.size("chunks").alias("total_chunks_in_image"),
                         F.transform("chunks", lambda c: words_n(c["chunk_text"])).alias("_wc"))
    per = per.withColumn("_maxw", F.array_max("_wc")).withColumn("_rows", F.arrays_zip("chunks", "_wc")).drop("chunks", "_wc")
    c = per.select("*", F.posexplode_outer("_rows").alias("chunk_idx", "_r")).filter("chunk_idx IS NOT NULL").select(
        KEY, *keep, "chunk_idx", "_len", "_words", "total_chunks_in_image", "_maxw", "_r.chunks.*", F.col("_r._wc").alias("chunk_word_count"))
    labelled = "chunk_label" in c.columns
    gen_len, gen_words = F.col("_len"), F.col("_words")
    n = F.col("total_chunks_in_image")
    i = F.col("chunk_idx")
    relpos = F.when(gen_len > 0, F.col("start") / gen_len).otherwise(F.lit(0.0))
    return c.select(
        KEY, *keep, "chunk_idx", "chunk_text", "chunk_type", "start", "end", "attribute", "object", "relation", "objects", *(["chunk_label"] if labelled else []),
        "chunk_word_count", relpos.alias("chunk_relative_position"), "total_chunks_in_image",
        F.when(n > 1, i / n).otherwise(F.lit(0.0)).alias("chunk_position_normalized"),
        (i == 0).cast("int").alias("is_first_chunk"), (i == n - 1).cast("int").alias("is_last_chunk"),
        ((i > 0) & (i < n - 1)).cast("int").alias("is_middle_chunk"),
        (F.col("chunk_word_count") / F.greatest(F.lit(1), F.col("_maxw"))).alias("word_count_normalized"),
        (F.col("chunk_word_count") <= 3).cast("int").alias("is_short_chunk"),
        (F.col("chunk_word_count") >= 8).cast("int").alias("is_long_chunk"),
        F.when(gen_words > 0, n / gen_words).otherwise(F.lit(0.0)).alias("chunks_density"),
        F.when(gen_len > 0, F.length("chunk_text") / gen_len).otherwise(F.lit(0.0)).alias("chunk_length_ratio"),
        (relpos * F.col("chunk_word_count")).alias("position_length_interaction"),
        (relpos * relpos).alias("position_squared"),
        (F.col("chunk_word_count") * F.col("chunk_word_count")).cast("int").alias("word_count_squared"),
        (F.col("chunk_type") == "object").cast("int").alias("is_object_chunk"),
        (F.col("chunk_type") == "attribute").cast("int").alias("is_attribute_chunk"),
        (F.col("chunk_type") == "relation").cast("int").alias("is_relation_chunk"),
        F.length("chunk_text").alias("chunk_length"))

"""Substring dedup by sliding sentence spans (operator 2).

Every run of consecutive sentences is hashed, the hashes are joined over all
documents, and sentences under any non-first occurrence go.  Sentences end at
the marks of many scripts; runs are measured in words, and text without spaces
between words in letters.

A first pass counts span hashes and marks the repeated ones in a bitmap of
fixed size, so that the join moves only spans that (almost surely) repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_has, narrow, record_batch, repeat_bitmap, stored, text_slices, texts_of, unused

MIN_SENTENCES = 2
MIN_WORDS = 20
ALONE_WORDS = 40
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n|[.!?]|$)\s*")
# Marks that end a sentence without white space after them: Arabic, Urdu, Devanagari, Armenian, Ethiopic, Tibetan, Burmese,
# Khmer, Chinese and Japanese; closing quotes and brackets stay with them.
_MARKS = "\u0589\u061f\u06d4\u0964\u0965\u0f0d\u0f0e\u104b\u1362\u1367\u17d4\u17d5\u3002\uff01\uff1f\uff61"
_MARK = re.compile(f"[{_MARKS}]")
_MARKED = re.compile(rf"[^.!?\n{_MARKS}]*(?:[.!?]*[{_MARKS}][.!?{_MARKS}]*[\"'\u2019\u201d\u300d\u300f\u300b\u3011\uff09)]*|[.!?]+(?=\s|$)|\n|[.!?]|$)\s*")
# Letters of scripts written without spaces between words: Han and kana; Thai, Lao, Tibetan, Burmese and Khmer, whose spaces end phrases.
_HAN = re.compile("[\u3005-\u3007\u3040-\u30ff\u3100-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af]")
_PHRASED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]")
_PHRASE = re.compile(rf"(?<=\s)(?={_PHRASED.pattern})")
_UNSPACED = re.compile(f"{_HAN.pattern[:-1]}{_PHRASED.pattern[1:]}")
HAN_A_WORD = 2  # letters that count as a word
PHRASED_A_WORD = 4


def sentences(text: str) -> list[str]:
    """The text cut after sentence ends and line ends, white space kept; the parts join to the text.

    '.', '!' and '?' end a sentence before white space, the marks of other
    scripts anywhere.  Phrases that start with a letter of Thai, Lao, Tibetan,
    Burmese or Khmer after white space are parts as well.
    """
    ascii_only = text.isascii()
    marked = not ascii_only and _MARK.search(text) is not None
    out, held = [], ""
    for part in (_MARKED if marked else _SENTENCE).findall(text):
        held += part
        if held and (held[-1].isspace() or not part or marked and _MARK.search(part)):
            out.append(held)
            held = ""
    out = [*out, held] if held else out
    return out if ascii_only or not _PHRASED.search(text) else [p for s in out for p in _PHRASE.split(s) if p]


def word_count(sentence: str, words: list[str]) -> int:
    """Words of a sentence; in scripts without spaces, its letters over the letters that count as a word, rounded up."""
    if sentence.isascii() or not _UNSPACED.search(sentence):
        return len(words)
    others = sum(any(map(str.isalnum, w)) for w in _UNSPACED.sub(" ", sentence).split())
    return max(1, others - (-len(_HAN.findall(sentence)) // HAN_A_WORD) - (-len(_PHRASED.findall(sentence)) // PHRASED_A_WORD))


def spans(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, alone_words: int = ALONE_WORDS) -> tuple[list[bytes], list[int], list[int]]:
    """128-bit hash, first sentence and length of each run.

    From each sentence the shortest run on, and to each sentence the shortest
    run back, with ``min_sentences`` sentences and ``min_words`` words; for a
    sentence of ``alone_words`` it is that sentence.  The runs back reach the
    last sentences of a repeated passage.  Sentences are compared in lower
    case with single spaces; those without a word count for nothing.  Words
    are those of ``word_count``.
    """
    cut = sentences(text.lower())
    parts = [(k, w) for k, w in enumerate(s.split() for s in cut) if w]
    if not parts:
        return [], [], []
    lines = [" ".join(w).encode() for _, w in parts]
    sizes = np.array([len(w) for _, w in parts] if text.isascii() else [word_count(cut[k], w) for k, w in parts])
    place = np.arange(len(parts))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    last = np.maximum(np.searchsorted(upto, upto[:-1] + min_words, side="left") - 1, place + min_sentences - 1)
    first = np.minimum(np.searchsorted(upto, upto[1:] - min_words, side="right") - 1, place - min_sentences + 1)
    alone = sizes >= alone_words
    last[alone], first[alone] = place[alone], place[alone]
    on, back = last < len(parts), first >= 0
    runs = np.unique(np.concatenate([place[on] * len(parts) + last[on], first[back] * len(parts) + place[back]]))
    a, b = runs // len(parts), runs % len(parts)
    ends = np.cumsum(np.array([len(x) + 1 for x in lines])) - 1
    starts = ends - np.array([len(x) for x in lines])
    joined, digest = b" ".join(lines), xxhash.xxh3_128_digest
    number = np.array([k for k, _ in parts])
    return ([digest(joined[x:y]) for x, y in zip(starts[a].tolist(), ends[b].tolist())], number[a].tolist(),
            (number[b] - number[a] + 1).tolist())


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def repeated_spans(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, text_hash, first, size): spans that occur earlier as well.

    Earlier means a smaller (doc_id, text_hash, sentence) place, null ids
    first.  Rows that repeat id and text are one document at one place.
    """
    spark = docs.sparkSession
    one = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in text_slices(batches):
            h = _halves([x for t in texts_of(batch) for x in spans(t, **limits)[0]])[:, 0]
            keys, n = np.unique(h, return_counts=True)
            yield record_batch(one, {"h": keys, "n": n})

    flags = spark.sparkContext.broadcast(repeat_bitmap(docs.select("text").mapInArrow(count, "h long, n long")))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("first", pa.int32()), ("size", pa.int32())])

    def emit(batches):
        for batch in text_slices(batches):
            found = [spans(t, **limits) for t in texts_of(batch)]
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            h = _halves([x for f in found for x in f[0]])
            hot = bitmap_has(flags.value, h[:, 0])
            take = pa.array(doc[hot])
            yield record_batch(schema, {
                "doc_id": batch.column("doc_id").take(take), "text_hash": batch.column("text_hash").take(take),
                "h1": h[hot, 0], "h2": h[hot, 1],
                "first": np.array([x for f in found for x in f[1]], dtype=np.int32)[hot],
                "size": np.array([x for f in found for x in f[2]], dtype=np.int32)[hot]})

    s = stored(docs.mapInArrow(emit, "doc_id long, text_hash long, h1 long, h2 long, first int, size int"), "spans")
    place = F.struct("doc_id", "text_hash", "first")
    firsts = (s.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.max(place).alias("last"))
              .filter(~F.col("keep").eqNullSafe(F.col("last"))).drop("last"))
    firsts = stored(firsts, "firsts")  # as a table of its own, so that a hot span's side of the join can be split
    return (s.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("keep")))
            .select("doc_id", "text_hash", "first", "size"))


def _stripped(texts: list, cuts: list) -> tuple[list, list, list]:
    """Texts without the sentences under any cut, sentences before, and sentences removed."""
    left, total, gone = [], [], []
    for text, spans_of in zip(texts, cuts):
        parts = sentences(text or "")
        cover = np.zeros(len(parts) + 1, dtype=np.int64)
        for c in spans_of or ():
            cover[c["first"]] += 1
            cover[c["first"] + c["size"]] -= 1
        keep = np.cumsum(cover)[:len(parts)] == 0
        left.append(text if keep.all() else "".join(p for p, k in zip(parts, keep.tolist()) if k))
        total.append(len(parts))
        gone.append(int((~keep).sum()))
    return left, total, gone


def _with_cuts(docs: DataFrame, id_col: str, text_col: str, limits: dict) -> DataFrame:
    """``docs`` with the spans to cut from each row's text as last column."""
    d = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    cuts = (repeated_spans(d, **limits).groupBy("doc_id", "text_hash")
            .agg(F.collect_set(F.struct("first", "size")).alias("cuts")))  # at most two spans per sentence
    i, h, last = unused(docs, "cut_id"), unused(docs, "cut_hash"), unused(docs, "cuts")
    c = cuts.withColumnsRenamed({"doc_id": i, "text_hash": h, "cuts": last})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h))
    return docs.join(c, same, "left").drop(i, h)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES,
                    min_words: int = MIN_WORDS, alone_words: int = ALONE_WORDS) -> DataFrame:
    """doc_id, text, n_sentences, n_removed, chars_removed of every row.

    A text without repeats comes back unchanged, one that repeats elsewhere
    as a whole comes back empty.  Null texts stay null.  Rows that repeat id
    and text are treated alike: they count as one document.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()),
                        ("chars_removed", pa.int64())])

    def run(batches):
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            left, total, gone = _stripped(texts, batch.column(batch.num_columns - 1).to_pylist())
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "text": left, "n_sentences": total, "n_removed": gone,
                                        "chars_removed": [len(a or "") - len(b or "") for a, b in zip(texts, left)]})

    limits = {"min_sentences": min_sentences, "min_words": min_words, "alone_words": alone_words}
    return _with_cuts(narrow(docs, id_col, text_col), "doc_id", "text", limits).mapInArrow(
        run, "doc_id long, text string, n_sentences long, n_removed long, chars_removed long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES,
                    min_words: int = MIN_WORDS, alone_words: int = ALONE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with repeated spans cut from the text."""
    def run(batches):
        for batch in text_slices(batches, text_col=text_col):
            left = _stripped(batch.column(text_col).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())[0]
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array(left, type=batch.schema.field(k).type)).drop_columns([batch.schema.names[-1]])

    limits = {"min_sentences": min_sentences, "min_words": min_words, "alone_words": alone_words}
    return _with_cuts(docs, id_col, text_col, limits).mapInArrow(run, docs.schema)

"""Default lexicon tagger: text -> ``tokens`` table (F5 default).

The reference runs a neural parser per row; here the parser is pluggable
and its output is the ``tokens`` table.  This default tagger is a Spark job:

* split each text into words and single other characters, each with the
  whitespace before it, so that lengths add up to character offsets;
* part of speech from closed word lists, then endings; any other word of
  letters is a noun, whose lemma is its singular; punctuation is PUNCT;
* heads by nearest-token rules inside a sentence: an adjective (or
  determiner) attaches to the next noun; a noun attaches to the preposition
  or verb just before it when no noun lies between (its object), else to the
  one just after it (its subject); everything else is a root.

A text's tokens are one array in its row (``with_tokens``): nothing is shuffled or
sorted.  Offsets and heads are running sums and running extremes over the token classes
of a batch of texts, so the cost is linear in the text.

``tokens_of`` is the same tagger for what only needs the tokens inside a task (chunks, reference
terms): what depends on a word is worked out once per distinct word of a batch.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.lexicons import (ACTION_RELATIONS, TAGGER_ADJECTIVES, TAGGER_CLOSED, TAGGER_DETERMINERS, TAGGER_NOUNS,
                                  TAGGER_PREPOSITIONS, TAGGER_STOP_WORDS, TAGGER_SUFFIXES, lemma_of, noun_lemma)
from ..functions.text import PY_WORD, PY_WS

PIECES = f"[{PY_WS}]*([{PY_WORD}]+|[^{PY_WORD}{PY_WS}])"
TOKEN_COLS = ["tok_idx", "text", "lemma", "pos", "dep", "head_idx", "char_start", "char_end", "is_stop"]
_NOUN, _REL, _MODIFIER, _END = 1, 2, 4, 8


def _pos(piece: Column, lw: Column, lem: Column) -> Column:
    pos = (F.when(lem.isin(*TAGGER_NOUNS), "NOUN").when(lw.isin(*TAGGER_ADJECTIVES), "ADJ")
            .when(lw.isin(*TAGGER_PREPOSITIONS), "ADP").when(lw.isin(*ACTION_RELATIONS), "VERB")
            .when(lw.isin(*TAGGER_DETERMINERS), "DET")
            .when(~piece.rlike(f"[{PY_WORD}]"), "PUNCT")
            .when(lw.isin(*TAGGER_STOP_WORDS, *TAGGER_CLOSED) | piece.rlike(r"[\p{N}_]"), "X"))
    for kind, ending in TAGGER_SUFFIXES:
        pos = pos.when((F.length(lw) > 4) & lw.rlike(ending), kind)
    return pos.otherwise("NOUN")


def heads(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end offset in its text, head) of each token.  ``code``: 16 x length with the space before + class; ``first``, ``last``: its text's range."""
    n = len(code)
    at = np.arange(n)
    upto = np.cumsum(code >> 4)
    end = upto - (upto - (code >> 4))[first]
    closes = code & _END > 0

    def before(mask):
        found = np.full(n, -1)
        found[1:] = np.maximum.accumulate(np.where(mask, at, -1))[:-1]
        return found

    def after(mask):
        found = np.full(n, n)
        found[:-1] = np.minimum.accumulate(np.where(mask, at, n)[::-1])[::-1][1:]
        return found

    # a sentence: from behind the end mark before to the next one, within the text
    lo, hi = np.maximum(before(closes) + 1, first), np.minimum(after(closes), last)
    noun, rel = code & _NOUN > 0, code & _REL > 0
    pn, nn, pr, nr = before(noun), after(noun), before(rel), after(rel)
    # a neighbour outside the sentence is none
    has_pn, has_nn, has_pr, has_nr = pn >= lo, nn < hi, pr >= lo, nr < hi
    head = np.where(noun & has_nr & (~has_nn | (nn > nr)), nr, at)
    head = np.where(noun & has_pr & (~has_pn | (pn < pr)), pr, head)
    head = np.where((code & _MODIFIER > 0) & has_nn, nn, head)
    return end, head - first


@F.arrow_udf(ArrayType(LongType()))
def _ends_and_heads(codes: pa.Array) -> pa.Array:
    """end * 2^32 + head of every token."""
    offsets = codes.offsets.to_numpy()
    code = codes.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    end, head = heads(code, np.repeat(offsets[:-1], size), np.repeat(offsets[1:], size)) if len(code) else (code, code)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((end.astype(np.int64) << 32) + head))


def with_tokens(df: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
    """``df`` with each text's tokens as an array of structs (``TOKEN_COLS``) in token order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit(PIECES), 1), lambda p: F.struct(p.alias("p"), F.lower(p).alias("l")))
    words = F.transform(words, lambda w: F.struct(w["p"].alias("p"), w["l"].alias("l"), noun_lemma(w["l"]).alias("n")))
    words = F.transform(words, lambda w: F.struct(w["p"].alias("p"), w["l"].alias("l"), w["n"].alias("n"), _pos(w["p"], w["l"], w["n"]).alias("k")))
    df = df.withColumn("_words", words)
    kind = lambda w: (F.when(w["k"].isin("NOUN", "PROPN"), _NOUN).when(w["k"].isin("ADP", "VERB"), _REL).when(w["k"].isin("ADJ", "DET"), _MODIFIER)
                      .when(w["p"].isin(".", "!", "?"), _END).otherwise(0))
    code = F.zip_with(F.regexp_extract_all(text, F.lit(PIECES), 0), "_words", lambda piece, w: (F.length(piece) * 16 + kind(w)).cast("bigint"))
    # declared nondeterministic (it is not), so that Spark computes it once and copies it into no later expression
    df = df.withColumn("_placed", _ends_and_heads.asNondeterministic()(code))

    def token(x, i):
        w = x["_words"]
        head, end = x["_placed"].bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright(x["_placed"], 32).cast("int")
        dep = F.when(w["k"] == "ADP", "prep").when(w["k"] == "ADJ", "amod").when(w["k"] == "DET", "det").otherwise(
            F.when(head == i, "ROOT").otherwise("dep"))
        return F.struct(i.alias("tok_idx"), w["p"].alias("text"), F.when(w["k"] == "NOUN", w["n"]).otherwise(w["l"]).alias("lemma"), w["k"].alias("pos"),
                        dep.alias("dep"), head.alias("head_idx"), (end - F.length(w["p"])).cast("int").alias("char_start"), end.alias("char_end"),
                        w["l"].isin(*TAGGER_STOP_WORDS).alias("is_stop"))
    return df.withColumn(out, F.transform(F.arrays_zip("_words", "_placed"), token)).drop("_words", "_placed")


def tag(df: DataFrame, ids: list[str], text_col: str = "text") -> DataFrame:
    """Tokens ``(*ids, tok_idx, text, lemma, pos, dep, head_idx, char_start, char_end, is_stop)``.

    An outer generator, since below any other Spark tests that the array is not empty, by computing it once more.
    """
    return with_tokens(df.select(*ids, text_col), text_col, "_tokens").select(*ids, F.inline_outer("_tokens")).filter("tok_idx IS NOT NULL")


# ---------------------------------------------------------------- the same inside a task
_PIECE = re.compile(r"\s*(?:\w+|[^\w\s])")  # PIECES in Python's own classes, which PY_WS and PY_WORD spell out
_KINDS = ({w: "DET" for w in TAGGER_DETERMINERS} | {w: "VERB" for w in ACTION_RELATIONS} | {w: "ADP" for w in TAGGER_PREPOSITIONS}
          | {w: "ADJ" for w in TAGGER_ADJECTIVES})
_NOUNS, _STOPS, _CLOSED = set(TAGGER_NOUNS), set(TAGGER_STOP_WORDS), {*TAGGER_STOP_WORDS, *TAGGER_CLOSED}
_ENDINGS = [(kind, re.compile(ending)) for kind, ending in TAGGER_SUFFIXES]
_CLASS = {"NOUN": _NOUN, "PROPN": _NOUN, "ADP": _REL, "VERB": _REL, "ADJ": _MODIFIER, "DET": _MODIFIER}


class Word(NamedTuple):
    """What follows from a piece of text alone: a token with the white space before it."""

    text: str
    lemma: str
    pos: str
    is_stop: bool
    code: int  # as ``heads`` takes it


def _kind(word: str, low: str, lemma: str) -> str:
    if lemma in _NOUNS:
        return "NOUN"
    if low in _KINDS:
        return _KINDS[low]
    if not (word[0] == "_" or word[0].isalnum()):
        return "PUNCT"
    if low in _CLOSED or any(c == "_" or unicodedata.category(c)[0] == "N" for c in word):
        return "X"
    if len(low) > 4:
        for kind, ending in _ENDINGS:
            if ending.search(low):
                return kind
    return "NOUN"


@functools.lru_cache(maxsize=1 << 16)
def word_of(piece: str) -> Word:
    word = piece.lstrip()
    low = word.lower()
    lemma = lemma_of(low)
    pos = _kind(word, low, lemma)
    kind = _CLASS.get(pos, _END if word in (".", "!", "?") else 0)
    return Word(word, lemma if pos == "NOUN" else low, pos, low in _STOPS, len(piece) * 16 + kind)


class _Numbered(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Tokens(NamedTuple):
    """Tokens of a run of texts, one after the other."""

    row: np.ndarray  # the text of each token
    place: np.ndarray  # its number in that text
    head: np.ndarray  # its head's position among all tokens
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray  # its number in ``words``
    words: list[Word]

    def are(self, test) -> np.ndarray:
        """Whether ``test(word)`` holds, for each token."""
        return np.fromiter(map(test, self.words), bool, len(self.words))[self.word]


def tokens_of(texts: list[str]) -> Tokens:
    numbers = _Numbered()
    found = list(map(_PIECE.findall, texts))
    size = np.fromiter(map(len, found), np.int64, len(found))
    word = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(size.sum()))
    words = [word_of(p) for p in numbers]
    first, row = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(word)) - first[row]
    if not len(word):
        return Tokens(row, place, place, place, place, word, words)
    end, head = heads(np.array([w.code for w in words], np.int64)[word], first[row], (first + size)[row])
    length = np.array([len(w.text) for w in words], np.int64)
    return Tokens(row, place, head + first[row], end - length[word], end, word, words)


def runs(sizes: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, behind last) of runs of rows of about ``most_bytes`` together, which bounds what a task holds."""
    start = total = 0
    for i, n in enumerate(sizes.to_pylist() if len(sizes) else []):
        if total and total + (n or 0) > most_bytes:
            yield start, i
            start, total = i, 0
        total += n or 0
    if start < len(sizes):
        yield start, len(sizes)

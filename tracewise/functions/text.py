"""Text column expressions with Python ``str`` semantics.

Python's ``str.split()`` / ``\\s`` / ``\\w`` are Unicode aware; Java and RE2
regexes default to ASCII.  The classes are therefore spelled out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# --- fixed values: Python's str.isspace() set, and \w = letters, numbers, '_' --
PY_WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WORD = r"\p{L}\p{N}_"
# ------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """``text.split()``: whitespace-separated words, empties removed (F7 default)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{PY_WS}]+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """``str.strip()`` (Spark ``trim`` removes only spaces)."""
    return F.regexp_replace(text, f"^[{PY_WS}]+|[{PY_WS}]+$", "")


def truncate_words(text: Column, n: int = 128) -> Column:
    """First ``n`` words joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def normalize(text: Column) -> Column:
    """lower, drop characters that are neither word nor space, strip."""
    return strip(F.regexp_replace(F.lower(text), f"[^{PY_WORD}{PY_WS}]", ""))


def sanitize_lines(text: Column, strip_ends: bool = False) -> Column:
    """``\\n`` and ``\\r`` to spaces, optionally stripped."""
    s = F.regexp_replace(text, "[\\n\\r]", " ")
    return strip(s) if strip_ends else s


def repetition_features(tokens: Column) -> tuple[Column, Column, Column]:
    """Token repetition, bigram repetition, unique ratio (T5, W10; features 71-73).

    1 - distinct/total; 1 - distinct bigrams/bigrams (0 for one token);
    distinct/total; all 0 for no tokens.  ``tokens`` is an array of words or
    token ids.
    """
    n = F.size(tokens)
    uniq = F.size(F.array_distinct(tokens))
    # a bigram as one string ("<len>:<left><right>") keeps array_distinct on
    # its hashed path; struct elements would be compared pairwise
    first = F.slice(tokens, 1, F.greatest(n - 1, F.lit(1)))
    second = F.slice(tokens, 2, F.greatest(n - 1, F.lit(1)))
    bigrams = F.zip_with(first, second, lambda a, b: F.concat(
        F.length(a.cast("string")).cast("string"), F.lit(":"), a.cast("string"), b.cast("string")))
    nb = F.size(F.array_distinct(bigrams))
    return _repetition(n, uniq, nb)


def _repetition(n: Column, uniq: Column, nb: Column) -> tuple[Column, Column, Column]:
    rep = F.when(n > 0, 1.0 - uniq / n).otherwise(F.lit(0.0))
    brep = F.when(n > 1, 1.0 - nb / (n - 1)).otherwise(F.lit(0.0))
    ur = F.when(n > 0, uniq / n).otherwise(F.lit(0.0))
    return rep, brep, ur


WORD_COUNTS = StructType([StructField("n", IntegerType()), StructField("uniq", IntegerType())])


@F.arrow_udf(WORD_COUNTS)
def _word_counts(texts: pa.Array) -> pa.Array:
    """Words and distinct words of each text."""
    n, uniq = [], []
    for t in texts:
        w = (t.as_py() or "").split()
        n.append(len(w))
        uniq.append(len(set(w)))
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(uniq, pa.int32())], ["n", "uniq"])


@F.arrow_udf(IntegerType())
def _bigram_count(texts: pa.Array) -> pa.Array:
    """Distinct pairs of neighbouring words of each text."""
    words = ((t.as_py() or "").split() for t in texts)
    return pa.array([len(set(zip(w, w[1:]))) for w in words], pa.int32())


def with_repetition(df: DataFrame, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    """``df`` with ``repetition_features`` of the words of a text; null reads as the empty text.

    A text is split and counted in one linear pass.  Words and bigrams are two functions, so that who takes no bigrams pays for none.
    """
    # declared nondeterministic (they are not), so that Spark computes each once and copies it into no later expression
    d = df.withColumn("_words", _word_counts.asNondeterministic()(F.col(text_col)))
    d = d.withColumn("_pairs", _bigram_count.asNondeterministic()(F.col(text_col)))
    found = _repetition(F.col("_words.n"), F.col("_words.uniq"), F.col("_pairs"))
    return d.withColumns(dict(zip(names, found))).drop("_words", "_pairs")


def split_aliases(s: Column, sep: str = ";") -> Column:
    """``;``-split, each stripped, empties removed."""
    return F.filter(F.transform(F.split(s, sep), lambda x: strip(x)), lambda x: x != "")


def join_aliases(arr: Column, sep: str = "; ") -> Column:
    """``"; ".join(list)``."""
    return F.array_join(arr, sep)

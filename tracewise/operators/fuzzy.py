"""String matching inside a sample without comparing all its pairs.

``contained_pairs`` finds substrings by seeds: a string can only lie in strings
that hold its rarest four-character gram, which an inverted index of the longer side looks up.
``similar_pairs`` finds what a similarity ratio can reach: shared characters
are counted as a multiset, and an inverted index over each string's rarest
characters (the prefix filter of set-similarity joins) names the candidates.
Both filters lose nothing; a check of the strings themselves follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions.similarity import ratios, similarity
from ..session import materialize

GRAM = 4
# Latin letters from the rarest in running text to the commonest; any fixed order is right, a good one keeps lists short
_LETTERS = "zqjxkvbywgpfmucdlhrsniotae"


def grams(s: Column, n: int = GRAM) -> Column:
    """Distinct runs of n characters, by one linear scan."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contained_pairs(short: DataFrame, long: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b): strings ``a`` of ``short`` that lie in strings ``b`` of ``long`` under equal keys.

    Strings of fewer than four characters (in ``short``) match nothing.  A string of n characters has at
    most n - 3 grams, so the work is linear in the texts, and each ``a`` follows its rarest gram alone.
    """
    short, long = short.select(*keys, a).distinct(), long.select(*keys, b).distinct()
    index = long.select(*keys, b, F.explode(grams(F.col(b))).alias("_gram"))
    lists = index.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = short.select(*keys, a, F.explode(grams(F.col(a))).alias("_gram")).join(lists, [*keys, "_gram"], "left")
    # a gram that no string of the other side holds ends the search
    seeds = (asked.groupBy(*keys, a).agg(F.count_if(F.col("_n").isNull()).alias("_missing"), F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
             .filter("_missing = 0").drop("_missing"))
    return seeds.join(index, [*keys, "_gram"]).filter(F.col(b).contains(F.col(a))).select(*keys, a, b)


def histogram(s: Column) -> Column:
    """Map of each character to how often it occurs."""
    chars = F.array_distinct(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)))
    n = F.length(s)
    return F.map_from_arrays(chars, F.transform(chars, lambda c: (n - F.length(F.replace(s, c, F.lit("")))).cast("int")))


def _prefix(hist: Column, size: Column, threshold: float) -> Column:
    """The rarest characters (with their occurrence number) of which a partner at ``threshold`` has at least one.

    A ratio of t or more shares at least t n / (2 - t) of a string's n characters, whatever the partner's length.
    """
    need = F.ceil(size * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))
    tokens = F.flatten(F.transform(F.map_entries(hist), lambda e: F.transform(
        F.sequence(F.lit(1), e["value"]), lambda k: F.struct((-k).alias("k"), F.instr(F.lit(_LETTERS), e["key"]).alias("r"), e["key"].alias("c")))))
    kept = F.slice(F.array_sort(tokens), F.lit(1), (size - need + 1).cast("int"))
    return F.transform(kept, lambda x: F.concat(x["c"], x["k"].cast("string")))


def profiles(strings: DataFrame, col: str, threshold: float) -> DataFrame:
    """(_s, _n, _hist, _prefix) of every distinct non-empty string: the vocabulary side of the index."""
    v = strings.select(F.col(col).alias("_s")).filter(F.length(col) > 0).distinct()
    v = v.select("_s", F.length("_s").alias("_n"), histogram(F.col("_s")).alias("_hist"))
    return v.withColumn("_prefix", _prefix(F.col("_hist"), F.col("_n"), threshold))


def candidate_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, vocabulary: DataFrame) -> DataFrame:
    """(keys, a, b): pairs under equal keys with a common entry in their prefixes; each pair once."""
    tokens = vocabulary.select("_s", F.explode("_prefix").alias("_token"))

    def posted(df, col):
        rows = df.select(*keys, col).distinct()
        return rows.join(tokens.withColumnRenamed("_s", col), col)

    return posted(left, a).join(posted(right, b), [*keys, "_token"]).select(*keys, a, b).distinct()


def scored_pairs(pairs: DataFrame, a: str, b: str, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio) of the distinct string pairs that reach ``threshold``; only those that share enough characters are compared."""
    v = vocabulary.select("_s", "_n", "_hist")
    both = (pairs.select(a, b).distinct()
            .join(v.select(F.col("_s").alias(a), F.col("_n").alias("_na"), F.col("_hist").alias("_ha")), a)
            .join(v.select(F.col("_s").alias(b), F.col("_n").alias("_nb"), F.col("_hist").alias("_hb")), b))
    shared = F.aggregate(F.map_entries("_ha"), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at("_hb", e["key"]), F.lit(0))))
    enough = both.filter(2 * shared >= F.lit(threshold) * (F.col("_na") + F.col("_nb")) - F.lit(1e-9)).select(a, b)
    return enough.withColumn("ratio", similarity(F.col(a), F.col(b))).filter(F.col("ratio") >= threshold)


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, threshold: float) -> DataFrame:
    """(keys, a, b, ratio): pairs of non-empty strings under equal keys with a ratio of at least ``threshold``.

    What depends on a string alone is computed once per distinct string, what
    depends on a pair of strings once per distinct pair, whatever number of keys they come under.
    """
    vocabulary = materialize(profiles(left.select(F.col(a).alias("_x")).unionByName(right.select(F.col(b).alias("_x"))), "_x", threshold))
    pairs = materialize(candidate_pairs(left, right, keys, a, b, vocabulary))
    return pairs.join(scored_pairs(pairs, a, b, vocabulary, threshold), [a, b]).select(*keys, a, b, "ratio")


_BLOCK = 1 << 18


def _shares(strings: list[str]) -> np.ndarray:
    """Characters of each string counted in 64 classes: equal characters fall into equal classes."""
    out = np.zeros((len(strings), 64), np.int32)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    np.add.at(out, (np.repeat(np.arange(len(strings)), size), codes % 64), 1)
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0])


def any_met(row: np.ndarray, left: np.ndarray, offsets: np.ndarray, right: np.ndarray, n_words: int, judge) -> np.ndarray:
    """For each string ``left`` (a number) of a row, whether one of that row's strings ``right[offsets[row]:offsets[row + 1]]`` meets ``judge``.

    Pairs are listed in blocks; ``judge`` (of two arrays of numbers) sees each distinct pair of strings once.
    """
    pairs = np.diff(offsets)[row]
    met, known = np.zeros(len(left), bool), {}
    upto = np.cumsum(pairs)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _BLOCK, side="right")))
        n = pairs[at:stop]
        of = np.repeat(np.arange(at, stop), n)
        given = np.repeat(offsets[row[at:stop]], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        keys, back = np.unique(left[of].astype(np.int64) * n_words + right[given], return_inverse=True)
        fresh = np.array([k for k in keys.tolist() if k not in known], np.int64)
        known.update(zip(fresh.tolist(), judge(fresh // max(n_words, 1), fresh % max(n_words, 1)).tolist()))
        hit = np.fromiter((known[k] for k in keys.tolist()), bool, len(keys))[back]
        met[of[hit]] = True
        at = stop
    return met


def ratio_judge(words: list[str], threshold: float):
    """A judge of numbered words: both are non-empty and reach ``threshold``, whatever their case.  Only pairs that share enough characters are compared."""
    words = [w.lower() for w in words]
    share, size = _shares(words), np.fromiter(map(len, words), np.int64, len(words))

    def judge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bound = np.concatenate([np.zeros(0, np.int64), *[np.minimum(share[x[i:i + 65536]], share[y[i:i + 65536]]).sum(axis=1) for i in range(0, len(x), 65536)]])
        near = (size[x] > 0) & (size[y] > 0) & (2 * bound >= threshold * (size[x] + size[y]) - 1e-9)
        which = np.flatnonzero(near)
        near[which] = ratios([words[i] for i in x[which]], [words[i] for i in y[which]]) >= threshold
        return near
    return judge


def any_similar(threshold: float):
    """A function of two arrays of strings: for each of the first, whether a non-empty one of the second reaches ``threshold``."""
    def run(asked: pa.Array, given: pa.Array) -> pa.Array:
        a0, a = lists(asked)
        b0, b = lists(given)
        both = pa.concat_arrays([a.cast(pa.string()), b.cast(pa.string())]).dictionary_encode()
        code, words = both.indices.to_numpy(), both.dictionary.to_pylist()
        met = any_met(np.repeat(np.arange(len(asked)), np.diff(a0)), code[:len(a)], b0, code[len(a):], len(words), ratio_judge(words, threshold))
        return pa.ListArray.from_arrays(pa.array(a0, pa.int32()), pa.array(met))
    run.__annotations__ = {"asked": pa.Array, "given": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(BooleanType()))

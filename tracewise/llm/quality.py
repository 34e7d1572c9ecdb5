"""Quality rules with adaptive thresholds (operator 7), DataFrame functions only.

Every signal is an integer ratio in 1/1024.  Its sketch is a histogram over
values cut to eight significant bits: relative error below 1/128, counts of
two sketches add up, and no order of merging changes it.  Fences are taken
per language and source from quantiles of the merged sketch; a group with
fewer than ``MIN_DOCS`` documents merges into its language, a language with
fewer into the whole.  No threshold has a fixed width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS = 100
REACH = 3  # fence distance in interquartile ranges
TAIL = 20  # at most one document in TAIL of a group lies beyond a fence
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array.

    Windows are compared by a 64-bit hash of their words.  Arrays without
    an equal pair stop at the distinct count; the others are sorted once by
    (hash, place), and the places with an equal neighbour cover their words.
    """
    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
        return F.aggregate(places, zero, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")))["n"]

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"].cast("long")))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, places), covered))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return of_words(words)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                    F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    counts = let(split_words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    with_word = F.filter(F.split("t", "\n"), lambda x: F.translate(x, WHITE, "") != "")
    lines = let(with_word, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    s = d.select("doc_id", "lang", "source", counts.alias("w"), lines.alias("l"),
                 F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
                 (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    s = s.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
                 F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words")
    return s.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratios() -> dict[str, Column]:
    """The adaptive signals, integer ratios in 1/1024."""
    part = lambda a, b: F.expr(f"({a} * 1024) div greatest({b}, 1)")
    return {"word_length": part("word_chars", "n_words"), "symbols": part("n_symbols", "n_words"),
            "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def sketches(s: DataFrame) -> DataFrame:
    """(lang, source, signal, value, n): one histogram sketch per group and signal, of documents with a word."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("x")) for k, v in ratios().items()]))
    x = s.filter("n_words > 0").select("lang", "source", each.alias("e")).select("lang", "source", "e.signal", "e.x")
    cut = F.expr("greatest(length(bin(x)) - 8, 0)")
    value = F.expr("shiftleft(shiftright(x, greatest(length(bin(x)) - 8, 0)), greatest(length(bin(x)) - 8, 0))")
    return x.withColumn("value", F.when(cut > 0, value).otherwise(F.col("x"))).groupBy("lang", "source", "signal", "value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "signal", "value").agg(F.sum("n").alias("n"))


def _ranked(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketch with the documents up to each value, and of the whole group and signal."""
    w = Window.partitionBy(*by, "signal").orderBy("value")
    return sketch.select(*by, "signal", "value", F.sum("n").over(w).alias("upto"),
                         F.sum("n").over(Window.partitionBy(*by, "signal")).alias("total"))


def _quantile(k: int, of: int) -> Column:
    """The least value with at least ``k / of`` of the group's documents up to it."""
    return F.min(F.when(of * F.col("upto") >= k * F.col("total"), F.col("value")))


def sketch_fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group: documents, and for each signal ``<signal>_low`` and ``<signal>_high``.

    A fence lies ``REACH`` interquartile ranges beyond its quartile, or at the
    quantile that leaves one document in ``TAIL`` beyond it if that is farther
    out.  The upper fence is the last value of its histogram cell.  Where the
    interquartile range is zero, the fences are the two tail quantiles; if
    those are zero too, a document needs the value zero.
    """
    q = _ranked(sketch, by).groupBy(*by, "signal").agg(
        F.max("total").alias("total"), _quantile(1, 4).alias("q1"), _quantile(3, 4).alias("q3"),
        _quantile(1, TAIL).alias("bottom"), _quantile(TAIL - 1, TAIL).alias("top"))
    reach = REACH * (F.col("q3") - F.col("q1"))
    q = q.select(*by, "signal", "total", F.least(F.col("q1") - reach, F.col("bottom")).alias("low"),
                 F.greatest(F.col("q3") + reach, F.col("top")).alias("high"))
    q = q.withColumn("high", F.expr("high + shiftleft(1L, greatest(length(bin(high)) - 8, 0)) - 1"))
    columns = [F.max("total").alias("docs")]
    for name in ratios():
        columns += [F.max(F.when(F.col("signal") == name, F.col(e))).alias(f"{name}_{e}") for e in ("low", "high")]
    return q.groupBy(*by).agg(*columns)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences of every (lang, source), from the finest merged sketch with at least MIN_DOCS documents."""
    limits = [f"{k}_{e}" for k in ratios() for e in ("low", "high")]
    named = lambda f, tag: f.select(*[c for c in f.columns if c in ("lang", "source", "one")], *[F.col(c).alias(f"{tag}_{c}") for c in ["docs", *limits]])
    fine = named(sketch_fences(sketch, ["lang", "source"]), "s").withColumn("one", F.lit(1))
    lang = named(sketch_fences(merged(sketch, "lang"), ["lang"]), "l")
    every = named(sketch_fences(merged(sketch).withColumn("one", F.lit(1)), ["one"]), "a")
    pick = lambda c: (F.when(F.col("s_docs") >= MIN_DOCS, F.col(f"s_{c}")).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_{c}"))
                      .otherwise(F.col(f"a_{c}")).alias(c))
    return fine.join(lang, "lang").join(every, "one").select("lang", "source", *[pick(c) for c in limits])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Signals and verdict of every row.

    ``kept``: not base_failed and each signal within its group's fences.  A
    null text has no words and fails the base rule; a null language or source
    counts as the empty string; repeated rows give a row each and count each.
    """
    s = stored(signals(docs, id_col, text_col, lang_col, source_col), "signals")
    t = stored(thresholds(stored(sketches(s), "sketches")), "thresholds")  # its size is known when the join is planned
    within = F.lit(True)
    for name, x in ratios().items():
        within = within & (x >= F.col(f"{name}_low")) & (x <= F.col(f"{name}_high"))
    return (s.join(t, ["lang", "source"], "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept")))

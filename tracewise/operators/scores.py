"""Candidate/reference scores and binary labels.

The reference scores pairs with an external model; here scores arrive as a
table, or come from the default scorer: token F1 computed as a Spark join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def best_score(scores: DataFrame, id_col: str = "id", score: str = "score") -> DataFrame:
    """Max score per id, compared as numbers.

    The original keeps scores as text, so its max is lexicographic
    (``'1e-05' > '0.9'``); numeric is what is meant.
    """
    return scores.groupBy(id_col).agg(F.max(F.col(score).cast("double")).alias("best_score"))


def label_v1(best: Column, threshold: float = 0.5) -> Column:
    """best score > t -> 0 (not hallucinated) else 1 (C15, first form)."""
    return F.when(best > threshold, F.lit(0)).otherwise(F.lit(1))


def label_v2(score: Column, threshold: float = 0.5) -> Column:
    """score < t -> 1 else 0 (C15, second form; differs at score == t)."""
    return F.when(score < threshold, F.lit(1)).otherwise(F.lit(0))


def token_f1(pairs: DataFrame, pair_id: str, cand: str, ref: str) -> DataFrame:
    """Token-overlap F1 per pair (C17 default scorer).

    F1 = 2 * sum_w min(c_cand(w), c_ref(w)) / (|cand| + |ref|) over lower-cased
    whitespace words; 0 when both are empty.  Counting is one group-by on
    (pair, word), so one huge pair still spreads over its words.
    """
    c = pairs.select(pair_id, F.explode(words(F.lower(F.col(cand)))).alias("w"), F.lit(1).alias("_c"),
                     F.lit(0).alias("_r"))
    r = pairs.select(pair_id, F.explode(words(F.lower(F.col(ref)))).alias("w"), F.lit(0).alias("_c"),
                     F.lit(1).alias("_r"))
    g = c.unionByName(r).groupBy(pair_id, "w").agg(F.sum("_c").alias("_nc"), F.sum("_r").alias("_nr"))
    m = g.groupBy(pair_id).agg(F.sum(F.least("_nc", "_nr")).alias("_m"), F.sum("_nc").alias("_tc"),
                               F.sum("_nr").alias("_tr"))
    out = pairs.select(pair_id).join(m, pair_id, "left")
    tot = F.coalesce(F.col("_tc"), F.lit(0)) + F.coalesce(F.col("_tr"), F.lit(0))
    return out.select(pair_id, F.when(tot > 0, 2.0 * F.coalesce(F.col("_m"), F.lit(0)) / tot)
                      .otherwise(F.lit(0.0)).alias("score"))


def primary_reference(df: DataFrame, value: str = "ground_truth_value", aliases: str = "ground_truth_aliases",
                      text: str = "generated_description", strict: bool = False) -> DataFrame:
    """Rows with text get a reference: the value, else the first alias.

    Rows with text but no reference raise in strict mode; otherwise they are
    dropped and reported by ``unpaired_rows``.
    """
    has_text = F.col(text).isNotNull() & (F.col(text) != "")
    first_alias = F.get(F.split(F.col(aliases), ";"), 0) if aliases in df.columns else F.lit(None)
    refc = F.coalesce(F.when(F.col(value) != "", F.col(value)), F.when(F.trim(first_alias) != "", F.trim(first_alias)))
    d = df.filter(has_text).withColumn("reference", refc)
    if strict:
        d = d.withColumn("reference", F.when(F.col("reference").isNull(),
                                             F.raise_error(F.lit("row with text but no reference"))
                                             ).otherwise(F.col("reference")))
        return d
    return d.filter(F.col("reference").isNotNull())


def binary_dataset(samples: DataFrame, best: DataFrame, id_col: str, threshold: float = 0.5) -> DataFrame:
    """Samples joined with their best score and binary label."""
    j = samples.join(best, id_col, "inner")
    return j.withColumn("bleurt_score", F.col("best_score")).withColumn(
        "binary_label", label_v2(F.col("best_score"), threshold)).drop("best_score")


def score_pairs(pairs: DataFrame, pair_id: str, cand: str, ref: str, scorer=None) -> DataFrame:
    """Score candidate/reference pairs.

    ``scorer`` is an optional vectorised ``pandas_udf`` (two string series ->
    double series), e.g. a learned metric; the default is ``token_f1``.
    """
    if scorer is None:
        return token_f1(pairs, pair_id, cand, ref)
    return pairs.select(pair_id, scorer(F.col(cand), F.col(ref)).alias("score"))

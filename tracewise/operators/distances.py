"""Distribution distances in long form (V2 general case)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sequence import ordered_index, with_leads


HOT_ROWS = 1 << 20  # observations of a key above which no task sees them all


def wasserstein_long(df: DataFrame, key: str, value: str, in_a: str, in_b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-D Wasserstein distance between two samples per key, any sizes.

    ``df`` holds one row per observation with 0/1 weights ``in_a`` / ``in_b``
    saying which sample it belongs to.  W = sum over consecutive distinct
    values x < x' of |F_a(x) - F_b(x)| * (x' - x).  Observations are shuffled once, by key, and
    their CDFs are running sums in order of the values; keys of more than ``hot_rows`` observations
    are combined per distinct value first and get their CDFs from skew-safe running sums.
    Keys missing either sample are dropped.
    """
    rows = df.select(key, value, in_a, in_b).filter(F.col(key).isNotNull())
    hot = materialize(rows.groupBy(key).count().filter(F.col("count") > hot_rows).select(key))  # few: a row per million at most
    if hot.isEmpty():
        return _by_key(rows, key, value, in_a, in_b)
    cold = _by_key(rows.join(F.broadcast(hot), key, "left_anti"), key, value, in_a, in_b)
    return cold.unionByName(_by_position(rows.join(F.broadcast(hot), key, "left_semi"), key, value, in_a, in_b))


def _by_key(rows: DataFrame, key: str, value: str, in_a: str, in_b: str) -> DataFrame:
    d = rows.repartition(key).groupBy(key, value).agg(F.sum(in_a).alias("_da"), F.sum(in_b).alias("_db"))
    every, by = Window.partitionBy(key), Window.partitionBy(key).orderBy(value)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select(key, (F.lead(value).over(by) - F.col(value)).alias("_gap"), *[F.sum(f"_d{s}").over(w).alias(f"_{c}{s}") for s in "ab" for c, w in (("c", upto), ("n", every))])
    d = d.filter((F.col("_na") > 0) & (F.col("_nb") > 0))
    term = F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb")) * F.col("_gap")
    return d.groupBy(key).agg(F.sum(F.coalesce(term, F.lit(0.0))).alias("wasserstein"))


def _by_position(rows: DataFrame, key: str, value: str, in_a: str, in_b: str) -> DataFrame:
    d = rows.groupBy(key, value).agg(F.sum(in_a).alias("_da"), F.sum(in_b).alias("_db"))
    n = d.groupBy(key).agg(F.sum("_da").alias("_na"), F.sum("_db").alias("_nb")).filter(
        (F.col("_na") > 0) & (F.col("_nb") > 0))
    r = ordered_index(d, key, [value], out="_i", sums=["_da", "_db"])
    r = with_leads(r.select(key, "_i", value, "_da_cum", "_db_cum"), key, "_i",
                   [value, "_da_cum", "_db_cum"], offsets=(1,))
    r = r.join(n, key)
    gap = F.col(f"{value}_lead1") - F.col(value)
    term = F.abs(F.col("_da_cum") / F.col("_na") - F.col("_db_cum") / F.col("_nb")) * gap
    return r.groupBy(key).agg(F.sum(F.coalesce(term, F.lit(0.0))).alias("wasserstein"))

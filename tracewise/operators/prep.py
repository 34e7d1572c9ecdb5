"""Training-set preparation: encode, split, balance, scale, weight.

Randomness comes from ``md5`` of ids (repeatable under any partitioning
and equal to what SQL engines compute), never from ``rand()``.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import Matrix
from .neighbours import LEAF_ROWS, TREES, nearest
from .report import class_weights, weights_of_counts
from .sequence import ordered_index


def _u01(*cols) -> F.Column:
    """Uniform [0, 1) from md5 of the joined columns (48 bits)."""
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16 ** 12)


def encode_labels(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """Alphabetical label index, as a label encoder does (M1).

    The rank is taken over the distinct labels (a handful of rows).
    """
    if isinstance(df, Matrix):
        return df.known()
    lab = df.select(label).distinct()
    lab = lab.withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(lab), label)


def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.2, seed: int = 42,
                     group: str | None = None) -> DataFrame:
    """Add ``is_test``.

    Per label, the ``ceil(test_size * n)`` rows with the smallest
    ``md5(id:seed)`` go to test.  Ranks come from ``ordered_index`` (range
    partitioned), so the largest class is not sorted by one task.  With
    ``group`` (e.g. the sample of a chunk) whole groups go to one side,
    by a hash threshold on the group id.
    """
    if group is not None:
        return df.withColumn("is_test", _u01(group, F.lit(str(seed))) < test_size)
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    d = df.withColumn("_h", key)
    r = ordered_index(d, label, ["_h", id_col], out="_r")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(F.broadcast(n), label)  # one row per class
    return r.withColumn("is_test", F.col("_r") < F.ceil(F.col("_n") * test_size)).drop("_h", "_r", "_n")


def balance_targets(df: DataFrame, label: str) -> DataFrame:
    """Per class: count, majority count and the deficit to synthesise."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    mx = F.max("n").over(Window.partitionBy())
    return c.select(label, "n", mx.alias("target"), (mx - F.col("n")).alias("deficit"))


def smote(train: DataFrame, id_col: str, label: str, features: list[str], k_max: int = 15,
          seed: int = 42, leaf_rows: int = LEAF_ROWS, trees: int = TREES) -> DataFrame:
    """Synthetic minority rows up to the majority count.

    * k = min(15, smallest class - 1) nearest neighbours (Euclidean) within
      the class, out of all its rows, by ``neighbours.nearest``: exact
      for classes of up to ``leaf_rows`` rows, above that the best of
      ``trees`` random-projection buckets (recall is measured by a query);
    * a row without any neighbour (class of one) is repeated as it is.
    * each row of a class gets ``deficit // n`` copies, the first
      ``deficit % n`` rows one more (round robin by hashed order);
    * copy j of row x picks neighbour ``md5(id, j) % k`` and
      lambda = u01(id, j): x + lambda * (nn - x).
    Returns the original rows plus synthetic ones (``is_synthetic``).
    """
    vec = F.array(*[F.col(c).cast("double") for c in features])
    base = train.select(id_col, label, vec.alias("_x"))
    tg = balance_targets(train, label)
    kmin = tg.agg(F.min("n")).first()[0]
    k = max(1, min(k_max, (kmin or 1) - 1))
    need = tg.filter(F.col("deficit") > 0).select(label, "n", "deficit")
    minority = materialize(base.join(F.broadcast(need), label))  # one row per class
    # copies go by hashed order
    ranked = ordered_index(minority.withColumn("_h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"),
                                                                       F.lit(str(seed))))),
                           label, ["_h", id_col], out="_r")
    # copies per row, round robin in hashed order
    copies = (F.floor(F.col("deficit") / F.col("n")) + (F.col("_r") < F.col("deficit") % F.col("n")).cast("int"))
    ranked = ranked.withColumn("_copies", copies.cast("int"))
    vectors = ranked.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.col("_x").alias("x"), (F.col("_copies") > 0).alias("asks"))
    # only rows that get copies need neighbours, out of all rows of the class
    near = nearest(vectors, k, leaf_rows, trees, seed, asks="asks")
    nn = near.join(vectors.select(F.col("id").alias("b"), F.col("x").alias("_xb")), "b").select(
        F.col("a").alias("_a"), (F.col("rank") - 1).cast("int").alias("_nn"), "_xb")
    ranked = ranked.filter(F.col("_copies") > 0)
    syn = ranked.select(F.col(id_col).cast("string").alias("_a"), label, "_x", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_j"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "_a", F.col("_j").cast("string"),
                                                        F.lit(str(seed)))), 1, 8), 16, 10).cast("long"),
                  F.lit(k)).cast("int")
    syn = syn.withColumn("_nn", pick).withColumn("_lam", _u01("_a", "_j", F.lit(str(seed) + "l")))
    syn = syn.join(nn, ["_a", "_nn"], "left")
    xs = F.zip_with("_x", F.coalesce("_xb", "_x"), lambda x, y: x + F.col("_lam") * (y - x))
    syn = syn.select(F.concat_ws("_", "_a", F.lit("syn"), F.col("_j").cast("string")).alias(id_col),
                     label, xs.alias("_x"), F.lit(True).alias("is_synthetic"))
    orig = base.select(F.col(id_col).cast("string").alias(id_col), label, "_x", F.lit(False).alias("is_synthetic"))
    out = orig.unionByName(syn)
    return out.select(id_col, label, *[F.col("_x")[i].alias(c) for i, c in enumerate(features)], "is_synthetic")


def fit_scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """One-row table of mean and population std per column, fit on train."""
    if isinstance(train, Matrix):
        return train.scaler()
    aggs = []
    for c in features:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mu"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sd")]
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / std, std 0 -> 1 (V12).  ``stats`` has one row: broadcasting it is bounded."""
    if isinstance(df, Matrix):
        return df.scaled(stats)
    j = df.crossJoin(F.broadcast(stats))
    out = j.withColumns({c: (F.col(c).cast("double") - F.col(f"{c}__mu")) /
                         F.when(F.col(f"{c}__sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__sd")) for c in features})
    return out.drop(*[f"{c}__mu" for c in features], *[f"{c}__sd" for c in features])


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Per-row weight column from the rare-class weights (M7)."""
    if isinstance(df, Matrix):
        counts = df.frame.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(df.counts) if n], "code int, n long")
        of = {r.code: r.weight for r in weights_of_counts(counts, "code").collect()}
        return replace(df, weights=np.array([of.get(i, 0.0) for i in range(len(df.classes))]))
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label)


def with_copies(df: DataFrame, id_col: str, weight: str, seed: int = 42, out: str = "_copies") -> DataFrame:
    """How often each row comes in ``weighted_copies``, as a column."""
    least = df.agg(F.min(weight).alias("_least"))  # one row
    ratio = F.round(F.col(weight) / F.col("_least"), 9)
    copies = F.floor(ratio) + (_u01(id_col, F.lit(f"{seed}w")) < ratio - F.floor(ratio)).cast("long")
    return df.crossJoin(F.broadcast(least)).withColumn(out, copies).drop("_least")


def weighted_copies(df: DataFrame, id_col: str, weight: str, seed: int = 42) -> DataFrame:
    """Rows repeated in proportion to their weight, for learners that take none (M8, M9).

    A row of the least weight comes once, one of r times that weight floor(r)
    times, and once more if a hash of its id falls below the rest of r, so
    that it comes r times on average.  No row is lost.
    """
    d = with_copies(df, id_col, weight, seed)
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copy", "_copies")

"""Ordered-sequence primitives that stay balanced when one key is huge.

A per-sample window (``Window.partitionBy(sample)``) sends every row of a
sample to one task.  If one sample holds a third of the data that task
holds a third of the data.  The helpers below give the same answers with
work spread by *row position*, not by key:

* ``ordered_index``   - 0-based position of a row inside its key, by a total
  order.  Range-partitions on (key, order) so a hot key spans many tasks,
  then adds per-(key, partition) offsets computed on a tiny side table.
* ``with_leads``      - values of the rows k steps ahead, by an equi-join on
  (key, step) expressed as one union + group-by (one shuffle, keys unique
  per step, so no hot group).
* ``exact_quantiles`` - numpy-style linear percentiles per key by counting
  values in bins, finer and finer around the wanted ranks, instead of
  sorting or buffering a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize

def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def _n_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_index(df: DataFrame, keys, order, out: str = "step",
                  num_partitions: int | None = None, sums: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = position (0-based) of each row within its key.

    ``order`` must be a total order inside a key (add a unique tie-break),
    which also makes the result identical when a lost task is recomputed.
    ``sums`` names numeric columns whose inclusive running sum (in the same
    order) is added as ``{c}_cum``; the within-partition part is a window over
    (key, range partition), so no window group exceeds one range partition.
    """
    keys, order = _cols(keys), _cols(order)
    n = _n_partitions(df, num_partitions)
    sort_cols = [*keys, *order]
    ranged = (df.repartitionByRange(n, *sort_cols)
                .sortWithinPartitions(*sort_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    # The range bounds are sampled with a seed tied to the plan instance, so
    # two branches that each re-plan the exchange could disagree.  A lazy
    # reliable checkpoint freezes one physical plan for both branches (one
    # shuffle) and cuts the lineage into the shared checkpoint folder.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=False)
    # one row per (key, partition it touches): at most #keys + #partitions rows
    spans = ranged.groupBy(*keys, "_pid").agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"),
        *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = spans.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    for c in sums:
        spans = spans.withColumn(f"_o_{c}", F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)))
    cond = [ranged[k].eqNullSafe(spans[k]) for k in keys] + [ranged["_pid"] == spans["_pid"]]
    joined = ranged.join(spans, cond, "inner").select(
        ranged["*"], spans["_m0"], spans["_off"], *[spans[f"_o_{c}"] for c in sums])
    joined = joined.withColumn(out, (F.col("_mid") - F.col("_m0") + F.col("_off")).cast("long"))
    if sums:
        local = Window.partitionBy(*keys, "_pid").orderBy("_mid").rowsBetween(
            Window.unboundedPreceding, 0)
        for c in sums:
            joined = joined.withColumn(f"{c}_cum", F.sum(c).over(local) + F.col(f"_o_{c}"))
    return joined.drop("_pid", "_mid", "_m0", "_off", *[f"_o_{c}" for c in sums])


def with_leads(df: DataFrame, keys, step: str, values: Sequence[str],
               offsets: Sequence[int] = (1,)) -> DataFrame:
    """For each row add ``{v}_lead{k}`` = value of ``v`` at ``step + k``.

    Same meaning as ``lead(v, k)`` over a dense step index, computed as a
    group-by on (key, step): each row is emitted once as itself and once per
    offset under ``step - k``.
    """
    keys = _cols(keys)
    parts = [df.select(*keys, F.col(step).alias(step), F.lit(0).alias("_k"),
                       *[F.col(v) for v in values])]
    for k in offsets:
        parts.append(df.select(*keys, (F.col(step) - k).alias(step), F.lit(k).alias("_k"),
                               *[F.col(v) for v in values]))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    aggs = [F.max(F.when(F.col("_k") == 0, F.lit(1))).alias("_self")]
    for v in values:
        aggs.append(F.max(F.when(F.col("_k") == 0, F.col(v))).alias(v))
        for k in offsets:
            aggs.append(F.max(F.when(F.col("_k") == k, F.col(v))).alias(f"{v}_lead{k}"))
    g = u.groupBy(*keys, step).agg(*aggs)
    return g.filter(F.col("_self") == 1).drop("_self")


def value_bin(v: Column) -> Column:
    """A whole number that never falls as ``v`` grows: sign, exponent and the first 256 steps between powers of two.

    Zero has 0 and NaN the largest number of all, as in Spark's order.
    """
    e = F.least(F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1100)), F.lit(1100))
    step = F.floor((F.abs(v) / F.pow(F.lit(2.0), e) - 1) * 256)
    size = (e + 1101) * 256 + F.least(F.greatest(step, F.lit(0)), F.lit(255))
    return (F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(F.abs(v) == F.lit(float("inf")), F.lit(1 << 39) * F.signum(v))
            .otherwise(F.signum(v) * size)).cast("long")


def exact_quantiles(df: DataFrame, keys, value: str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key (numpy ``percentile`` default).

    Returns one row per key with one column per entry of ``qs`` (name -> q in
    [0, 1]).  Null values are ignored.

    Radix selection: values are counted per (key, bin), which the tasks do
    before the shuffle, and running counts over a key's bins find the bin of each
    wanted rank.  A bin of one value, or a rank at a bin's end, is
    settled; the other bins' rows alone are counted again in finer bins.  The rows are never
    sorted, and a key of any size is spread over its bins.
    """
    keys = _cols(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows.withColumn("_bin", value_bin(F.col("_v")))
    by = Window.partitionBy(*keys).orderBy("_bin")
    hist = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranked = hist.withColumns({"_upto": F.sum("_c").over(by), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("pos"),
                                fn(F.lit(float(q)) * (F.col("_n") - 1)).cast("long").alias("rank"))
                       for name, q in qs.items() for end, fn in (("lo", F.floor), ("hi", F.ceil))])
    inside = F.filter(wanted, lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_c")))
    found = ranked.select(*keys, F.explode(inside).alias("_w"), "_bin", "_c", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_before")).select(
        *keys, "_w.q", "_w.end", "_w.pos", (F.col("_w.rank") - F.col("_before")).alias("_r"), "_bin", "_c", "_lo", "_hi")
    value_at = (F.when((F.col("_lo") == F.col("_hi")) | (F.col("_r") == 0), F.col("_lo")).when(F.col("_r") == F.col("_c") - 1, F.col("_hi")))
    settled = None
    while True:
        found = materialize(found.withColumn("_x", value_at))
        done = found.filter("_x IS NOT NULL").select(*keys, "q", "end", "pos", "_x")
        settled = done if settled is None else settled.unionByName(done)
        left = found.filter("_x IS NULL").select(*keys, "q", "end", "pos", "_r", F.col("_bin").alias("_old"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b"))
        if left.isEmpty():
            break
        # finer bins of the open bins only; a bin's ends move together by at least the factor 4096 a round
        open_ = left.select(*keys, "_old", "_a", "_b").distinct()
        same = lambda x, y: [x[k].eqNullSafe(y[k]) for k in keys]
        rows = materialize(rows.join(open_, [*same(rows, open_), rows["_bin"] == open_["_old"]]).select(*[rows[k] for k in keys], "_v", "_old", "_a", "_b"))
        # halves first: the difference of two large values of unlike sign would be infinite
        share = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        digit = F.least(F.floor(share * 4096), F.lit(4095)).cast("decimal(5,0)")
        fine = rows.withColumn("_bin", (F.col("_old").cast("decimal(38,0)") * F.lit(4096).cast("decimal(5,0)") + digit).cast("decimal(38,0)"))
        rows = fine.select(*keys, "_v", "_bin", "_old")
        hist = rows.groupBy(*keys, "_old", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        ranked = hist.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_old").orderBy("_bin")))
        cond = [*same(left, ranked), left["_old"] == ranked["_old"], left["_r"] < ranked["_upto"], left["_r"] >= ranked["_upto"] - ranked["_c"]]
        found = left.join(ranked, cond).select(*[left[k] for k in keys], "q", "end", "pos", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"),
                                               ranked["_bin"], "_c", "_lo", "_hi")
        rows = rows.drop("_old")
    at = lambda name, end: F.max(F.when((F.col("q") == name) & (F.col("end") == end), F.col("_x")))
    pos = lambda name: F.max(F.when(F.col("q") == name, F.col("pos")))
    between = lambda n: at(n, "lo") + F.coalesce((pos(n) - F.floor(pos(n))) * (at(n, "hi") - at(n, "lo")), F.lit(0.0))
    return settled.groupBy(*keys).agg(*[between(n).alias(n) for n in qs])

"""Layer-to-layer signal features from hidden states and attentions.

Input rows: ``(sample_id, step, layer, values ARRAY<FLOAT>)`` (attentions add
``n_heads``).  One row per (sample, step, layer); a group (sample, step)
holds one vector per layer, so its size is bounded by the model depth, not
by the data.  All work is one shuffle on (sample_id, step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import concentration, cosine, head_mean, softmax, wasserstein_sorted
from ..functions.catalog import layer_start

KEY = "sample_id"
N_SLOTS = 30


def _start(model_type) -> Column:
    return layer_start(F.lit(model_type) if isinstance(model_type, str) else model_type)


def selected_layers(states: DataFrame, model_type="llava") -> DataFrame:
    """Keep the compared layers of each (sample, step).

    primary: start+2, start+4, ... <= min(start+32, max_layer); if that gives
    fewer than two layers: max(0, max_layer-15), +2, ... <= max_layer.
    Adds ``max_layer`` and ``layer_start``.
    """
    w = Window.partitionBy(KEY, "step")
    s = states.withColumn("max_layer", F.max("layer").over(w)).withColumn("layer_start", _start(model_type))
    start, ml, lay = F.col("layer_start"), F.col("max_layer"), F.col("layer")
    hi = F.least(start + 32, ml)
    n_primary = F.when(hi >= start + 2, F.floor((hi - start - 2) / 2) + 1).otherwise(F.lit(0))
    lo_fb = F.greatest(F.lit(0), ml - 15)
    primary = (lay >= start + 2) & (lay <= hi) & ((lay - start) % 2 == 0)
    fallback = (lay >= lo_fb) & (lay <= ml) & ((lay - lo_fb) % 2 == 0)
    return s.filter(F.when(n_primary >= 2, primary).otherwise(fallback))


def layer_pairs(states: DataFrame, model_type="llava") -> DataFrame:
    """Long form ``(sample_id, step, pair_idx, n_layers, wasserstein, cosine)``.

    Each selected vector is softmax-normalised over its flattened values;
    softmax is monotone, so the sorted copy used by the Wasserstein distance
    is the softmax of the sorted vector.
    """
    sel = selected_layers(states, model_type)
    sel = sel.withColumn("prob", softmax(F.col("values"))).withColumn(
        "prob_sorted", softmax(F.array_sort(F.col("values"))))
    w = Window.partitionBy(KEY, "step").orderBy("layer")
    sel = (sel.withColumn("next_prob", F.lead("prob").over(w))
              .withColumn("next_sorted", F.lead("prob_sorted").over(w))
              .withColumn("pair_idx", F.row_number().over(w) - 1)
              .withColumn("n_layers", F.count(F.lit(1)).over(Window.partitionBy(KEY, "step"))))
    return sel.filter(F.col("next_prob").isNotNull()).select(
        KEY, "step", "pair_idx", "n_layers",
        wasserstein_sorted(F.col("prob_sorted"), F.col("next_sorted")).alias("wasserstein"),
        cosine(F.col("prob"), F.col("next_prob")).alias("cosine"))


def layer_shift_long(states: DataFrame, model_type="llava") -> DataFrame:
    """``(sample_id, slot, value)``: per-slot mean over steps.

    Slot ``j`` < n-1 holds the j-th distance, slot ``n-1+j`` the j-th cosine,
    n being the layer count of that step.  The divisor is the number of
    steps with at least one pair.  Slots >= 30 are dropped.  A sample with a
    pair of unequal vector sizes has failed and gives no rows, so that the
    feature row takes zeros and its failure mark (P15).
    """
    p = layer_pairs(states, model_type)
    long = p.select(KEY, "step", F.col("pair_idx").alias("slot"), F.col("wasserstein").alias("v")).unionByName(
        p.select(KEY, "step", (F.col("n_layers") - 1 + F.col("pair_idx")).alias("slot"),
                 F.col("cosine").alias("v")))
    long = long.filter(F.col("slot") < N_SLOTS)
    steps = (p.groupBy(KEY).agg(F.countDistinct("step").alias("_steps"), F.max(F.col("wasserstein").isNull()).alias("_failed"))
             .filter(~F.col("_failed")))
    sums = long.groupBy(KEY, "slot").agg(F.sum("v").alias("_s"))
    return sums.join(steps, KEY).select(KEY, F.col("slot").cast("int").alias("slot"),
                                        (F.col("_s") / F.col("_steps")).alias("value"))


def layer_shift(states: DataFrame, model_type="llava", offset: int = 0, prefix: str = "feature_") -> DataFrame:
    """30 zero-padded columns ``feature_{offset}..feature_{offset+29}`` per sample (V4/V5)."""
    long = layer_shift_long(states, model_type)
    wide = long.groupBy(KEY).pivot("slot", list(range(N_SLOTS))).agg(F.first("value"))
    return wide.select(KEY, *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"{prefix}{offset + i}")
                              for i in range(N_SLOTS)])


def step_consistency(states: DataFrame, model_type="llava", layer: int = 0) -> DataFrame:
    """Features 62 / 63: agreement of one layer between an early and a late step.

    max = steps - 1; early = min(start+5, max-10); late = max-2; if
    early >= late or early < start: early = max(start, max // 2), late = max-1.
    Fewer than two steps, a step index out of range, or vectors of unequal
    size give (0, 0).
    """
    base = states.filter(F.col("layer") == layer).select(KEY, "step", "values")
    n = base.groupBy(KEY).agg(F.max("step").alias("max_idx"), F.count(F.lit(1)).alias("_n"))
    start = _start(model_type)
    mx = F.col("max_idx")
    e0, l0 = F.least(start + 5, mx - 10), mx - 2
    bad = (e0 >= l0) | (e0 < start)
    n = n.select(KEY, "_n", "max_idx",
                 F.when(bad, F.greatest(start, F.floor(mx / 2))).otherwise(e0).cast("int").alias("early"),
                 F.when(bad, mx - 1).otherwise(l0).cast("int").alias("late"))
    e = base.select(KEY, F.col("step").alias("early"), F.col("values").alias("ev"))
    lt = base.select(KEY, F.col("step").alias("late"), F.col("values").alias("lv"))
    j = n.join(e, [KEY, "early"], "left").join(lt, [KEY, "late"], "left")
    c = cosine(F.col("ev"), F.col("lv"))
    cons = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 1.0) / 2.0))
    ok = (F.col("_n") >= 2) & c.isNotNull()
    return j.select(KEY, F.when(ok, cons).otherwise(F.lit(0.0)).alias("feature_62"),
                    F.when(ok, 1.0 - cons).otherwise(F.lit(0.0)).alias("feature_63"))


def attention_concentration(attn: DataFrame, last_n: int = 3, layer: int = 0) -> DataFrame:
    """Features 64 / 65: mean and population std of concentration.

    Last ``last_n`` steps, one layer, mean over heads, then
    abs(2*sum(cumsum(sorted))/(n*sum) - 1).
    """
    a = attn.filter(F.col("layer") == layer)
    # last steps by step number: rank from the end with a per-sample max
    mx = a.groupBy(KEY).agg(F.max("step").alias("_mx"))
    a = a.join(mx, KEY).filter(F.col("step") > F.col("_mx") - last_n)
    conc = concentration(head_mean(F.col("values"), F.col("n_heads")))
    a = a.select(KEY, conc.alias("c"))
    return a.groupBy(KEY).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("feature_64"),
                              F.coalesce(F.stddev_pop("c"), F.lit(0.0)).alias("feature_65"))


def logit_extremes_long(logits: DataFrame) -> DataFrame:
    """Max / min softmax probability per (sample, step) from long logits (V6).

    ``logits(sample_id, step, logit)``: p_max = 1/sum(exp(x-max)),
    p_min = exp(min-max)/sum(exp(x-max)).  Two aggregates with partial
    combine; the per-step max is joined back (one row per step).
    """
    m = logits.groupBy(KEY, "step").agg(F.max("logit").alias("_m"), F.min("logit").alias("_lo"))
    s = logits.join(m, [KEY, "step"]).groupBy(KEY, "step", "_m", "_lo").agg(
        F.sum(F.exp(F.col("logit") - F.col("_m"))).alias("_z"))
    return s.select(KEY, "step", (F.lit(1.0) / F.col("_z")).alias("p_max"),
                    (F.exp(F.col("_lo") - F.col("_m")) / F.col("_z")).alias("p_min"))

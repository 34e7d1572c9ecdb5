"""Per-sample features from a probability trace.

Input: ``prob_trace(sample_id, step, p_max, p_min)`` with a dense 0-based
``step`` per sample (see ``sequence.ordered_index``).  Every function is a
group-by on ``sample_id`` (partial aggregation before the shuffle, so a hot
sample is combined map-side), plus ``with_leads`` where consecutive steps
are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import exact_quantiles, with_leads

KEY = "sample_id"


def _p(col="p_max"):
    return F.col(col).cast("double")


def confidence_block(trace: DataFrame, p: str = "p_max") -> DataFrame:
    """Features 66-70.

    66 mean of 1/max(p, 1e-10) ("perplexity"), 67 its population std,
    68 least-squares slope of p on step (0 for one step), 69 mean p,
    70 share of steps with p < 0.5.
    """
    inv = F.lit(1.0) / F.greatest(_p(p), F.lit(1e-10))
    return trace.groupBy(KEY).agg(
        F.avg(inv).alias("feature_66"),
        F.stddev_pop(inv).alias("feature_67"),
        F.coalesce(F.regr_slope(_p(p), F.col("step").cast("double")), F.lit(0.0)).alias("feature_68"),
        F.avg(_p(p)).alias("feature_69"),
        F.avg((_p(p) < 0.5).cast("double")).alias("feature_70"),
    )


def trace_statistics(trace: DataFrame, p: str = "p_max") -> DataFrame:
    """mean, population std, min, max, median and IQR of p."""
    base = trace.groupBy(KEY).agg(
        F.avg(_p(p)).alias("mean"), F.stddev_pop(_p(p)).alias("std"),
        F.min(_p(p)).alias("min"), F.max(_p(p)).alias("max"))
    q = exact_quantiles(trace, KEY, p, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(q, KEY).select(
        KEY, "mean", "std", "min", "max", F.col("q50").alias("median"),
        (F.col("q75") - F.col("q25")).alias("iqr"))


def entropy_and_counts(trace: DataFrame, p: str = "p_max", suffix: str = "max",
                       low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Normalised entropy (A10), low / high counts.

    entropy = -sum(p ln p over p > 0) / ln(n), 0 when ln(n) <= 0; p is not
    renormalised.
    """
    n = F.count(F.lit(1))
    ent = F.coalesce(F.sum(F.when(_p(p) > 0, -_p(p) * F.ln(_p(p)))), F.lit(0.0))
    return trace.groupBy(KEY).agg(
        F.when(n > 1, ent / F.ln(n.cast("double"))).otherwise(F.lit(0.0)).alias(f"norm_entropy_{suffix}"),
        F.count_if(_p(p) < low).alias(f"low_prob_count_{suffix}"),
        F.count_if(_p(p) > high).alias(f"high_prob_count_{suffix}"),
    )


def step_deltas(trace: DataFrame, values=("p_max", "p_min")) -> DataFrame:
    """Rows (sample_id, step, v, v_lead1, v_lead3) for every step."""
    return with_leads(trace, KEY, "step", list(values), offsets=(1, 3))


def gradient_features(trace: DataFrame, values=("p_max", "p_min")) -> DataFrame:
    """Mean and max absolute step-to-step change, 0 with fewer than 2 steps."""
    d = with_leads(trace, KEY, "step", list(values), offsets=(1,))
    aggs = []
    for v, sfx in zip(values, ("max", "min")):
        g = F.abs(F.col(f"{v}_lead1").cast("double") - F.col(v).cast("double"))
        aggs += [F.coalesce(F.avg(g), F.lit(0.0)).alias(f"mean_grad_{sfx}"),
                 F.coalesce(F.max(g), F.lit(0.0)).alias(f"max_grad_{sfx}")]
    return d.groupBy(KEY).agg(*aggs)


def transition_metrics(trace: DataFrame, p: str = "p_max", drop: float = -0.3) -> DataFrame:
    """Transition metrics on consecutive differences.

    max_drop = min(0, min delta), max_increase = max(0, max delta),
    total_volatility = sum |delta|, num_significant_drops = #(delta < -0.3),
    largest_window_drop = max(0, -min(0, min of 3-step sums)) when there are
    at least 3 deltas.  A 3-step sum telescopes to p[i+3] - p[i].  A sample
    with one step gets zeros.
    """
    d = with_leads(trace.select(KEY, "step", p), KEY, "step", [p], offsets=(1, 3))
    delta = F.col(f"{p}_lead1").cast("double") - F.col(p).cast("double")
    win3 = F.col(f"{p}_lead3").cast("double") - F.col(p).cast("double")
    g = d.groupBy(KEY).agg(
        F.min(delta).alias("_dmin"), F.max(delta).alias("_dmax"),
        F.sum(F.abs(delta)).alias("_vol"), F.count_if(delta < drop).alias("_nsig"),
        F.count(delta).alias("_nd"), F.min(win3).alias("_w3"))
    return g.select(
        KEY,
        F.coalesce(F.least(F.lit(0.0), F.col("_dmin")), F.lit(0.0)).alias("max_drop"),
        F.coalesce(F.greatest(F.lit(0.0), F.col("_dmax")), F.lit(0.0)).alias("max_increase"),
        F.coalesce(F.col("_vol"), F.lit(0.0)).alias("total_volatility"),
        F.col("_nsig").alias("num_significant_drops"),
        F.when(F.col("_nd") >= 3, F.greatest(F.lit(0.0), -F.least(F.col("_w3"), F.lit(0.0))))
         .otherwise(F.lit(0.0)).alias("largest_window_drop"))


def percentiles(trace: DataFrame, p: str = "p_max", qs=(25, 50, 75)) -> DataFrame:
    """Linear percentiles of p per sample."""
    return exact_quantiles(trace, KEY, p, {f"p{q}_max": q / 100.0 for q in qs})


def extremes(trace: DataFrame) -> DataFrame:
    """feature_60 -> min of p_max, feature_61 -> max spread p_max - p_min."""
    return trace.groupBy(KEY).agg(
        F.min(_p("p_max")).alias("min_p_max"),
        F.max(_p("p_max") - _p("p_min")).alias("max_spread"))


def perplexity_ratio(trace: DataFrame, lengths: DataFrame, p: str = "p_max") -> DataFrame:
    """Generation perplexity over prompt perplexity.

    NLL of steps before ``prompt_len`` and of the rest, each divided by the
    *declared* length (prompt_len, gen_len) and exponentiated; a zero length
    gives 1.0.
    """
    nll = -F.ln(F.greatest(_p(p), F.lit(1e-10)))
    t = trace.join(lengths.select(KEY, "prompt_len"), KEY)
    s = t.groupBy(KEY).agg(
        F.coalesce(F.sum(F.when(F.col("step") < F.col("prompt_len"), nll)), F.lit(0.0)).alias("_np"),
        F.coalesce(F.sum(F.when(F.col("step") >= F.col("prompt_len"), nll)), F.lit(0.0)).alias("_ng"))
    s = s.join(lengths, KEY)
    pp = F.when(F.col("prompt_len") > 0, F.exp(F.col("_np") / F.col("prompt_len"))).otherwise(F.lit(1.0))
    gp = F.when(F.col("gen_len") > 0, F.exp(F.col("_ng") / F.col("gen_len"))).otherwise(F.lit(1.0))
    return s.select(KEY, "prompt_len", "gen_len", (gp / pp).alias("perplexity_ratio"))


def probability_block(trace: DataFrame) -> DataFrame:
    """The offline probability feature block.

    feature_60 / feature_61 become min p_max and max spread; plus normalised
    entropies, low counts and mean gradients of both traces and the 25/50/75
    percentiles of p_max.  One group-by gives all but the percentiles.
    """
    d = with_leads(trace, KEY, "step", ["p_max", "p_min"], offsets=(1,))
    n = F.count(F.lit(1))
    aggs = [F.min(_p("p_max")).alias("feature_60"), F.max(_p("p_max") - _p("p_min")).alias("feature_61")]
    for v, sfx in (("p_max", "max"), ("p_min", "min")):
        entropy = F.coalesce(F.sum(F.when(_p(v) > 0, -_p(v) * F.ln(_p(v)))), F.lit(0.0))
        aggs += [F.when(n > 1, entropy / F.ln(n.cast("double"))).otherwise(F.lit(0.0)).alias(f"norm_entropy_{sfx}"),
                 F.count_if(_p(v) < 0.1).alias(f"low_prob_count_{sfx}"),
                 F.coalesce(F.avg(F.abs(_p(f"{v}_lead1") - _p(v))), F.lit(0.0)).alias(f"mean_grad_{sfx}")]
    block = d.groupBy(KEY).agg(*aggs).join(percentiles(trace), KEY)
    return block.select(KEY, "feature_60", "feature_61", "norm_entropy_max", "low_prob_count_max", "norm_entropy_min", "low_prob_count_min",
                        "mean_grad_max", "mean_grad_min", "p25_max", "p50_max", "p75_max")


def trace_arrays(trace: DataFrame) -> DataFrame:
    """feature_60 / feature_61 as ordered lists of p_max / p_min per sample.

    This is the one place a whole trace becomes one value, because the
    feature *is* the list; it is bounded by the generation length.
    """
    return trace.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("step", "p_max", "p_min"))).alias("_s")
    ).select(KEY, F.col("_s.p_max").alias("feature_60"), F.col("_s.p_min").alias("feature_61"))


def row_features(p: "F.Column", prefix: str = "") -> dict:
    """Trace features of one ``ARRAY<DOUBLE>`` of probabilities, per row.

    Same formulas as the grouped versions (A8-A16, A9, W2, W3), written as
    higher-order functions so a stream of finished samples needs no state
    (X1).  Every per-row value used inside a lambda is passed in through
    ``zip_with`` so each element is visited a constant number of times.
    """
    from ..functions.arrays import _with_scalar
    n = F.size(p)
    some = F.when(n > 0, n)  # null for an empty trace, whose features are all zero
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    mean = s / some
    inv = F.transform(p, lambda x: F.lit(1.0) / F.greatest(x, F.lit(1e-10)))
    inv_mean = F.aggregate(inv, F.lit(0.0), lambda a, x: a + x) / some
    inv_var = F.aggregate(_with_scalar(inv, inv_mean, lambda x, m: (x - m) * (x - m)), F.lit(0.0),
                          lambda a, x: a + x) / some
    var = F.aggregate(_with_scalar(p, mean, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x) / some
    # slope of p on 0..n-1: sum((i - ibar) * p) / sum((i - ibar)^2)
    ibar = (n - 1) / 2.0
    num = F.aggregate(_with_scalar(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), ibar,
                                   lambda t, b: (t["i"] - b) * t["x"]), F.lit(0.0), lambda a, x: a + x)
    den = n * (n * n - 1) / 12.0
    deltas = F.zip_with(F.slice(p, 2, F.greatest(n - 1, F.lit(1))), F.slice(p, 1, F.greatest(n - 1, F.lit(1))),
                        lambda b, a: b - a)
    deltas = F.when(n > 1, deltas).otherwise(F.array().cast("array<double>"))
    nd = F.size(deltas)
    w3 = F.when(n > 3, F.zip_with(F.slice(p, 4, F.greatest(n - 3, F.lit(1))), F.slice(p, 1, F.greatest(n - 3, F.lit(1))),
                                  lambda b, a: b - a))
    ent = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, -x * F.ln(x)).otherwise(F.lit(0.0)))
    srt = F.array_sort(p)

    def pct(q):
        pos = (n - 1) * q
        lo = F.floor(pos).cast("int")
        hi = F.ceil(pos).cast("int")
        vlo, vhi = F.get(srt, lo), F.get(srt, hi)
        return vlo + (pos - lo) * (vhi - vlo)

    z = F.lit(0.0)
    out = {
        f"{prefix}feature_66": F.when(n > 0, inv_mean).otherwise(z),
        f"{prefix}feature_67": F.when(n > 0, F.sqrt(inv_var)).otherwise(z),
        f"{prefix}feature_68": F.when(n > 1, num / den).otherwise(z),
        f"{prefix}feature_69": F.when(n > 0, mean).otherwise(z),
        f"{prefix}feature_70": F.when(n > 0, F.size(F.filter(p, lambda x: x < 0.5)) / n).otherwise(z),
        f"{prefix}mean": mean, f"{prefix}std": F.sqrt(var),
        f"{prefix}min": F.array_min(p), f"{prefix}max": F.array_max(p),
        f"{prefix}median": pct(0.5), f"{prefix}iqr": pct(0.75) - pct(0.25),
        f"{prefix}norm_entropy": F.when(n > 1, ent / F.ln(n.cast("double"))).otherwise(z),
        f"{prefix}low_prob_count": F.size(F.filter(p, lambda x: x < 0.1)),
        f"{prefix}high_prob_count": F.size(F.filter(p, lambda x: x > 0.9)),
        f"{prefix}mean_grad": F.when(nd > 0, F.aggregate(deltas, F.lit(0.0), lambda a, x: a + F.abs(x)) / nd)
                               .otherwise(z),
        f"{prefix}max_grad": F.coalesce(F.array_max(F.transform(deltas, lambda x: F.abs(x))), z),
        f"{prefix}max_drop": F.coalesce(F.least(z, F.array_min(deltas)), z),
        f"{prefix}max_increase": F.coalesce(F.greatest(z, F.array_max(deltas)), z),
        f"{prefix}total_volatility": F.aggregate(deltas, F.lit(0.0), lambda a, x: a + F.abs(x)),
        f"{prefix}num_significant_drops": F.size(F.filter(deltas, lambda x: x < -0.3)),
        f"{prefix}largest_window_drop": F.when(nd >= 3, F.greatest(z, -F.least(F.array_min(w3), z))).otherwise(z),
    }
    return {k: F.when(n > 0, v).otherwise(F.lit(0)) for k, v in out.items()}

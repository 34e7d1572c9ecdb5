"""Queries over the probability trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces
from ..sources import fixtures
from .registry import register, rounded

# DuckDB restatement of fixtures.prob_trace / trace_lengths
PROB_TRACE = """prob_trace AS (
  SELECT user_id AS sample_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
         1.0::DOUBLE / (1.0::DOUBLE + value) AS p_max,
         (1.0::DOUBLE / (1.0::DOUBLE + value)) / (2 + event_id % 7) AS p_min
  FROM events)"""

LEADS = """leads AS (
  SELECT *, lead(p_max, 1) OVER w AS p_max_lead1, lead(p_min, 1) OVER w AS p_min_lead1,
            lead(p_max, 3) OVER w AS p_max_lead3
  FROM prob_trace WINDOW w AS (PARTITION BY sample_id ORDER BY step))"""


def _trace(spark, sf):
    return fixtures.prob_trace(spark, sf)


@register("trace_step_index", "P4/W-order: dense step index per sample (prob_trace)", f"""
WITH {PROB_TRACE}
SELECT sample_id, step, round(p_max, 6) AS p_max, round(p_min, 6) AS p_min FROM prob_trace""")
def trace_step_index(spark, sf):
    return rounded(_trace(spark, sf))


@register("trace_confidence_block", "A9 W5 (features 66-70)", f"""
WITH {PROB_TRACE}
SELECT sample_id,
  round(avg(1.0::DOUBLE / greatest(p_max, 1e-10)), 6) AS feature_66,
  round(stddev_pop(1.0::DOUBLE / greatest(p_max, 1e-10)), 6) AS feature_67,
  round(coalesce(regr_slope(p_max, step::DOUBLE), 0.0::DOUBLE), 6) AS feature_68,
  round(avg(p_max), 6) AS feature_69,
  round(avg(CASE WHEN p_max < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS feature_70
FROM prob_trace GROUP BY sample_id""")
def trace_confidence_block(spark, sf):
    return rounded(traces.confidence_block(_trace(spark, sf)))


@register("trace_statistics", "A8 A15", f"""
WITH {PROB_TRACE}
SELECT sample_id, round(avg(p_max), 6) AS mean, round(stddev_pop(p_max), 6) AS std,
  round(min(p_max), 6) AS min, round(max(p_max), 6) AS max,
  round(quantile_cont(p_max, 0.5), 6) AS median,
  round(quantile_cont(p_max, 0.75) - quantile_cont(p_max, 0.25), 6) AS iqr
FROM prob_trace GROUP BY sample_id""")
def trace_statistics(spark, sf):
    return rounded(traces.trace_statistics(_trace(spark, sf)))


def _entropy_sql(p, sfx):
    return f"""CASE WHEN count(*) > 1 THEN coalesce(sum(CASE WHEN {p} > 0 THEN -{p} * ln({p}) END), 0.0::DOUBLE)
               / ln(count(*)::DOUBLE) ELSE 0.0::DOUBLE END AS norm_entropy_{sfx},
  count_if({p} < 0.1) AS low_prob_count_{sfx}, count_if({p} > 0.9) AS high_prob_count_{sfx}"""


@register("trace_entropy_counts", "A10 A11 A12", f"""
WITH {PROB_TRACE}, e AS (
  SELECT sample_id, {_entropy_sql('p_max', 'max')}, {_entropy_sql('p_min', 'min')}
  FROM prob_trace GROUP BY sample_id)
SELECT sample_id, round(norm_entropy_max, 6) AS norm_entropy_max, low_prob_count_max, high_prob_count_max,
       round(norm_entropy_min, 6) AS norm_entropy_min, low_prob_count_min, high_prob_count_min FROM e""")
def trace_entropy_counts(spark, sf):
    t = _trace(spark, sf)
    return rounded(traces.entropy_and_counts(t, "p_max", "max").join(
        traces.entropy_and_counts(t, "p_min", "min"), "sample_id"))


@register("trace_gradients", "A13 A14 W2", f"""
WITH {PROB_TRACE}, {LEADS}
SELECT sample_id,
  round(coalesce(avg(abs(p_max_lead1 - p_max)), 0.0::DOUBLE), 6) AS mean_grad_max,
  round(coalesce(max(abs(p_max_lead1 - p_max)), 0.0::DOUBLE), 6) AS max_grad_max,
  round(coalesce(avg(abs(p_min_lead1 - p_min)), 0.0::DOUBLE), 6) AS mean_grad_min,
  round(coalesce(max(abs(p_min_lead1 - p_min)), 0.0::DOUBLE), 6) AS max_grad_min
FROM leads GROUP BY sample_id""")
def trace_gradients(spark, sf):
    return rounded(traces.gradient_features(_trace(spark, sf)))


@register("trace_transitions", "W3", f"""
WITH {PROB_TRACE}, {LEADS}, g AS (
  SELECT sample_id, min(p_max_lead1 - p_max) AS dmin, max(p_max_lead1 - p_max) AS dmax,
         sum(abs(p_max_lead1 - p_max)) AS vol, count_if(p_max_lead1 - p_max < -0.3) AS nsig,
         count(p_max_lead1 - p_max) AS nd, min(p_max_lead3 - p_max) AS w3
  FROM leads GROUP BY sample_id)
SELECT sample_id,
  round(coalesce(least(0.0::DOUBLE, dmin), 0.0::DOUBLE), 6) AS max_drop,
  round(coalesce(greatest(0.0::DOUBLE, dmax), 0.0::DOUBLE), 6) AS max_increase,
  round(coalesce(vol, 0.0::DOUBLE), 6) AS total_volatility,
  nsig AS num_significant_drops,
  round(CASE WHEN nd >= 3 THEN greatest(0.0::DOUBLE, -least(w3, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END, 6)
    AS largest_window_drop
FROM g""")
def trace_transitions(spark, sf):
    return rounded(traces.transition_metrics(_trace(spark, sf)))


@register("trace_extremes", "A16", f"""
WITH {PROB_TRACE}
SELECT sample_id, round(min(p_max), 6) AS min_p_max, round(max(p_max - p_min), 6) AS max_spread
FROM prob_trace GROUP BY sample_id""")
def trace_extremes(spark, sf):
    return rounded(traces.extremes(_trace(spark, sf)))


@register("trace_perplexity_ratio", "A17", f"""
WITH {PROB_TRACE},
n AS (SELECT user_id AS sample_id, CAST(user_id % 11 AS INTEGER) AS prompt_len,
             CAST(greatest(count(*) - user_id % 11, 0) AS INTEGER) AS gen_len
      FROM events GROUP BY user_id),
s AS (SELECT t.sample_id,
        coalesce(sum(CASE WHEN t.step < n.prompt_len THEN -ln(greatest(t.p_max, 1e-10)) END), 0.0::DOUBLE) AS np,
        coalesce(sum(CASE WHEN t.step >= n.prompt_len THEN -ln(greatest(t.p_max, 1e-10)) END), 0.0::DOUBLE) AS ng
      FROM prob_trace t JOIN n USING (sample_id) GROUP BY t.sample_id)
SELECT s.sample_id, n.prompt_len, n.gen_len,
  round((CASE WHEN n.gen_len > 0 THEN exp(ng / n.gen_len) ELSE 1.0::DOUBLE END)
      / (CASE WHEN n.prompt_len > 0 THEN exp(np / n.prompt_len) ELSE 1.0::DOUBLE END), 6) AS perplexity_ratio
FROM s JOIN n USING (sample_id)""")
def trace_perplexity_ratio(spark, sf):
    return rounded(traces.perplexity_ratio(_trace(spark, sf), fixtures.trace_lengths(spark, sf)))


@register("probability_feature_block", "V15 A10 A11 A13 A15 A16", f"""
WITH {PROB_TRACE}, {LEADS}, b AS (
  SELECT sample_id, min(p_max) AS feature_60, max(p_max - p_min) AS feature_61,
    CASE WHEN count(*) > 1 THEN coalesce(sum(CASE WHEN p_max > 0 THEN -p_max * ln(p_max) END), 0.0::DOUBLE)
         / ln(count(*)::DOUBLE) ELSE 0.0::DOUBLE END AS norm_entropy_max,
    CASE WHEN count(*) > 1 THEN coalesce(sum(CASE WHEN p_min > 0 THEN -p_min * ln(p_min) END), 0.0::DOUBLE)
         / ln(count(*)::DOUBLE) ELSE 0.0::DOUBLE END AS norm_entropy_min,
    count_if(p_max < 0.1) AS low_prob_count_max, count_if(p_min < 0.1) AS low_prob_count_min,
    coalesce(avg(abs(p_max_lead1 - p_max)), 0.0::DOUBLE) AS mean_grad_max,
    coalesce(avg(abs(p_min_lead1 - p_min)), 0.0::DOUBLE) AS mean_grad_min,
    quantile_cont(p_max, 0.25) AS p25_max, quantile_cont(p_max, 0.5) AS p50_max,
    quantile_cont(p_max, 0.75) AS p75_max
  FROM leads GROUP BY sample_id)
SELECT sample_id, round(feature_60, 6) AS feature_60, round(feature_61, 6) AS feature_61,
  round(norm_entropy_max, 6) AS norm_entropy_max, low_prob_count_max,
  round(norm_entropy_min, 6) AS norm_entropy_min, low_prob_count_min,
  round(mean_grad_max, 6) AS mean_grad_max, round(mean_grad_min, 6) AS mean_grad_min,
  round(p25_max, 6) AS p25_max, round(p50_max, 6) AS p50_max, round(p75_max, 6) AS p75_max
FROM b""")
def probability_feature_block(spark, sf):
    return rounded(traces.probability_block(_trace(spark, sf)))


@register("trace_lists", "feature_60/61 as ordered lists (S12 form), elements rounded", f"""
WITH {PROB_TRACE}
SELECT sample_id, count(*)::INTEGER AS n_steps,
  list(round(p_max, 6) ORDER BY step) AS feature_60, list(round(p_min, 6) ORDER BY step) AS feature_61
FROM prob_trace GROUP BY sample_id""")
def trace_lists(spark, sf):
    t = traces.trace_arrays(_trace(spark, sf))
    r = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return t.select("sample_id", F.size("feature_60").alias("n_steps"),
                    r(F.col("feature_60")).alias("feature_60"), r(F.col("feature_61")).alias("feature_61"))


TRACE_ROW_FEATURES = f"""
WITH {PROB_TRACE}, {LEADS}
SELECT sample_id,
  round(avg(1.0::DOUBLE / greatest(p_max, 1e-10)), 6) AS feature_66,
  round(stddev_pop(1.0::DOUBLE / greatest(p_max, 1e-10)), 6) AS feature_67,
  round(coalesce(regr_slope(p_max, step::DOUBLE), 0.0::DOUBLE), 6) AS feature_68,
  round(avg(p_max), 6) AS feature_69,
  round(avg(CASE WHEN p_max < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS feature_70,
  round(quantile_cont(p_max, 0.5), 6) AS median,
  round(quantile_cont(p_max, 0.75) - quantile_cont(p_max, 0.25), 6) AS iqr,
  round(CASE WHEN count(*) > 1 THEN coalesce(sum(CASE WHEN p_max > 0 THEN -p_max * ln(p_max) END), 0.0::DOUBLE)
        / ln(count(*)::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS norm_entropy,
  round(coalesce(avg(abs(p_max_lead1 - p_max)), 0.0::DOUBLE), 6) AS mean_grad,
  round(CASE WHEN count(p_max_lead1) >= 3 THEN greatest(0.0::DOUBLE, -least(min(p_max_lead3 - p_max), 0.0::DOUBLE))
        ELSE 0.0::DOUBLE END, 6) AS largest_window_drop
FROM leads GROUP BY sample_id"""


@register("trace_row_features", "X1 form (per-row array features == grouped features)", TRACE_ROW_FEATURES)
def trace_row_features(spark, sf):
    a = traces.trace_arrays(_trace(spark, sf))
    f = traces.row_features(F.col("feature_60"))
    keep = ["feature_66", "feature_67", "feature_68", "feature_69", "feature_70", "median", "iqr",
            "norm_entropy", "mean_grad", "largest_window_drop"]
    return rounded(a.select("sample_id", *[f[k].alias(k) for k in keep]))


@register("trace_list_order", "feature_60/61 lists: length, first, last and sum (order and content)", f"""
WITH {PROB_TRACE}
SELECT sample_id, count(*)::INTEGER AS n_steps,
  round(arg_min(p_max, step), 6) AS first_max, round(arg_max(p_max, step), 6) AS last_max,
  round(arg_min(p_min, step), 6) AS first_min, round(arg_max(p_min, step), 6) AS last_min,
  round(sum(p_max), 4) AS sum_max, round(sum(p_min), 4) AS sum_min
FROM prob_trace GROUP BY sample_id""")
def trace_list_order(spark, sf):
    t = traces.trace_arrays(_trace(spark, sf))
    s = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    r6 = rounded(t.select("sample_id", F.size("feature_60").alias("n_steps"),
                          F.element_at("feature_60", 1).alias("first_max"),
                          F.element_at("feature_60", -1).alias("last_max"),
                          F.element_at("feature_61", 1).alias("first_min"),
                          F.element_at("feature_61", -1).alias("last_min")))
    r4 = rounded(t.select("sample_id", s(F.col("feature_60")).alias("sum_max"),
                          s(F.col("feature_61")).alias("sum_min")), 4)
    return r6.join(r4, "sample_id")

"""Queries over layer vectors and logits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import softmax, softmax_extremes, wasserstein_sorted
from ..functions.catalog import LAYER_START
from ..operators import layers
from ..sources import fixtures, tables
from .registry import register, rounded

STATES = """states AS (
  SELECT vec_id // 20 AS sample_id, CAST((vec_id % 20) // 5 AS INTEGER) AS step,
         CAST(vec_id % 5 AS INTEGER) AS layer, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings)"""


def _softmax_sql(v):
    return (f"list_transform(list_transform({v}, lambda x: exp(x - list_max({v}))), "
            f"lambda y: y / list_sum(list_transform({v}, lambda x: exp(x - list_max({v})))))")


def _cos_sql(a, b):
    return (f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8) * "
            f"greatest(sqrt(list_dot_product({b}, {b})), 1e-8))")


def _shift_sql(start: int, source: str = "states", prob_src: str = "v") -> str:
    """DuckDB restatement of layers.layer_shift_long for a literal start."""
    return f"""
sel AS (
  SELECT *, least({start} + 32, max_layer) AS hi, greatest(0, max_layer - 15) AS lo_fb FROM (
    SELECT *, max(layer) OVER (PARTITION BY sample_id, step) AS max_layer FROM {source}) m),
kept AS (
  SELECT sample_id, step, layer, {_softmax_sql(prob_src)} AS prob,
         {_softmax_sql(f'list_sort({prob_src})')} AS ps
  FROM sel
  WHERE CASE WHEN (CASE WHEN hi >= {start} + 2 THEN floor((hi - {start} - 2) / 2) + 1 ELSE 0 END) >= 2
             THEN layer >= {start} + 2 AND layer <= hi AND (layer - {start}) % 2 = 0
             ELSE layer >= lo_fb AND layer <= max_layer AND (layer - lo_fb) % 2 = 0 END),
pairs AS (
  SELECT sample_id, step, row_number() OVER w - 1 AS pair_idx,
         count(*) OVER (PARTITION BY sample_id, step) AS n_layers,
         prob, ps, lead(prob) OVER w AS nprob, lead(ps) OVER w AS nps
  FROM kept WINDOW w AS (PARTITION BY sample_id, step ORDER BY layer)),
pv AS (
  SELECT sample_id, step, pair_idx, n_layers,
         list_sum(list_transform(range(1, len(ps) + 1), lambda i: abs(ps[i] - nps[i]))) / len(ps) AS w,
         {_cos_sql('prob', 'nprob')} AS c
  FROM pairs WHERE nprob IS NOT NULL),
slots AS (
  SELECT sample_id, pair_idx AS slot, w AS val FROM pv
  UNION ALL SELECT sample_id, n_layers - 1 + pair_idx AS slot, c AS val FROM pv),
nsteps AS (SELECT sample_id, count(DISTINCT step) AS ns FROM pv GROUP BY sample_id),
shift AS (
  SELECT s.sample_id, CAST(s.slot AS INTEGER) AS slot, sum(coalesce(s.val, 0.0::DOUBLE)) / max(n.ns) AS value
  FROM slots s JOIN nsteps n USING (sample_id) WHERE s.slot < 30 GROUP BY s.sample_id, s.slot)"""


def _wide_sql(offset: int) -> str:
    cols = ", ".join(f"round(coalesce(max(CASE WHEN slot = {i} THEN value END), 0.0::DOUBLE), 6) "
                     f"AS feature_{offset + i}" for i in range(30))
    return f"SELECT sample_id, {cols} FROM shift GROUP BY sample_id"


@register("layer_selection", "P3 P6 (selected layers per step, llm and llava rules)", f"""
WITH {STATES}, m AS (SELECT *, max(layer) OVER (PARTITION BY sample_id, step) AS max_layer FROM states),
r AS (SELECT 'llm' AS model_type, 0 AS st UNION ALL SELECT 'llava', 24),
x AS (SELECT m.*, r.model_type, r.st, least(r.st + 32, m.max_layer) AS hi,
             greatest(0, m.max_layer - 15) AS lo_fb FROM m CROSS JOIN r)
SELECT model_type, sample_id, step, layer, CAST(st AS INTEGER) AS layer_start FROM x
WHERE CASE WHEN (CASE WHEN hi >= st + 2 THEN floor((hi - st - 2) / 2) + 1 ELSE 0 END) >= 2
           THEN layer >= st + 2 AND layer <= hi AND (layer - st) % 2 = 0
           ELSE layer >= lo_fb AND layer <= max_layer AND (layer - lo_fb) % 2 = 0 END""")
def layer_selection(spark, sf):
    s = fixtures.layer_states(spark, sf)
    out = None
    for mt in ("llm", "llava"):
        d = layers.selected_layers(s, mt).select(
            F.lit(mt).alias("model_type"), "sample_id", "step", "layer", F.col("layer_start").cast("int"))
        out = d if out is None else out.unionByName(d)
    return out


@register("hidden_layer_shift_long", "A7 V2 V3 W1 (long form, llm rule)", f"""
WITH {STATES}, {_shift_sql(LAYER_START['llm'])}
SELECT sample_id, slot, round(value, 6) AS value FROM shift""")
def hidden_layer_shift_long(spark, sf):
    return rounded(layers.layer_shift_long(fixtures.layer_states(spark, sf), "llm"))


@register("hidden_layer_shift", "V4 (features 0-29, llava rule -> fallback layers)", f"""
WITH {STATES}, {_shift_sql(LAYER_START['llava'])}
{_wide_sql(0)}""")
def hidden_layer_shift(spark, sf):
    return rounded(layers.layer_shift(fixtures.layer_states(spark, sf), "llava", offset=0))


ATTN = f"""{STATES}, attn AS (SELECT sample_id, step, layer, 4 AS n_heads, {_softmax_sql('v')} AS a FROM states)"""


@register("attention_layer_shift", "V5 (features 30-59, llm rule)", f"""
WITH {ATTN}, {_shift_sql(LAYER_START['llm'], 'attn', 'a')}
{_wide_sql(30)}""")
def attention_layer_shift(spark, sf):
    return rounded(layers.layer_shift(fixtures.attention_states(spark, sf), "llm", offset=30))


def _consistency_sql(start: int) -> str:
    return f"""
WITH {STATES}, base AS (SELECT sample_id, step, v FROM states WHERE layer = 0),
n AS (SELECT sample_id, count(*) AS n, max(step) AS mx FROM base GROUP BY sample_id),
n2 AS (SELECT sample_id, n, mx, least({start} + 5, mx - 10) AS e0, mx - 2 AS l0 FROM n),
n3 AS (SELECT sample_id, n,
         CASE WHEN e0 >= l0 OR e0 < {start} THEN greatest({start}, floor(mx / 2)) ELSE e0 END AS early,
         CASE WHEN e0 >= l0 OR e0 < {start} THEN mx - 1 ELSE l0 END AS late FROM n2),
j AS (SELECT n3.sample_id, n3.n, {_cos_sql('e.v', 'l.v')} AS c
      FROM n3 LEFT JOIN base e ON e.sample_id = n3.sample_id AND e.step = n3.early
              LEFT JOIN base l ON l.sample_id = n3.sample_id AND l.step = n3.late)
SELECT sample_id,
  round(CASE WHEN n >= 2 AND c IS NOT NULL THEN least(1.0, greatest(0.0, (c + 1.0) / 2.0)) ELSE 0.0 END, 6)::DOUBLE
    AS feature_62,
  round(CASE WHEN n >= 2 AND c IS NOT NULL THEN 1.0 - least(1.0, greatest(0.0, (c + 1.0) / 2.0)) ELSE 0.0 END, 6)::DOUBLE
    AS feature_63
FROM j"""


@register("step_consistency", "V7 W11 (features 62-63, llm rule)", _consistency_sql(LAYER_START["llm"]))
def step_consistency(spark, sf):
    return rounded(layers.step_consistency(fixtures.layer_states(spark, sf), "llm"))


@register("step_consistency_out_of_range", "V7 (llava start beyond the steps -> zeros)",
          _consistency_sql(LAYER_START["llava"]))
def step_consistency_oor(spark, sf):
    return rounded(layers.step_consistency(fixtures.layer_states(spark, sf), "llava"))


@register("attention_concentration", "V8 W9 (features 64-65)", f"""
WITH {ATTN},
mx AS (SELECT sample_id, max(step) AS m FROM attn WHERE layer = 0 GROUP BY sample_id),
hm AS (SELECT a.sample_id, list_sort(list_transform(range(0, len(a.a) // a.n_heads),
          lambda j: list_sum(list_transform(range(0, a.n_heads), lambda k: a.a[k * (len(a.a) // a.n_heads) + j + 1]))
                    / a.n_heads)) AS s
       FROM attn a JOIN mx USING (sample_id) WHERE a.layer = 0 AND a.step > mx.m - 3),
c AS (SELECT sample_id, CASE WHEN list_sum(s) = 0 THEN 0.0::DOUBLE ELSE
        abs(2.0 * list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i] * (len(s) - i + 1)))
            / (len(s) * list_sum(s)) - 1.0) END AS c FROM hm)
SELECT sample_id, round(coalesce(avg(c), 0.0), 6)::DOUBLE AS feature_64,
       round(coalesce(stddev_pop(c), 0.0), 6)::DOUBLE AS feature_65
FROM c GROUP BY sample_id""")
def attention_concentration(spark, sf):
    return rounded(layers.attention_concentration(fixtures.attention_states(spark, sf)))


@register("logit_extremes_long", "V6 (long-form logits, lineitem)", """
WITH lg AS (SELECT l_suppkey AS sample_id, l_linenumber AS step, l_quantity / 10.0 AS logit FROM lineitem),
m AS (SELECT sample_id, step, max(logit) AS mx, min(logit) AS mn FROM lg GROUP BY ALL),
z AS (SELECT lg.sample_id, lg.step, max(m.mx) AS mx, max(m.mn) AS mn, sum(exp(lg.logit - m.mx)) AS z
      FROM lg JOIN m USING (sample_id, step) GROUP BY lg.sample_id, lg.step)
SELECT sample_id, step, round(1.0 / z, 6)::DOUBLE AS p_max, round(exp(mn - mx) / z, 6)::DOUBLE AS p_min FROM z""")
def logit_extremes_long(spark, sf):
    return rounded(layers.logit_extremes_long(fixtures.logits_long(spark, sf)))


@register("logit_extremes_array", "V1 V6 (array logits: every embedding vector read as one logit vector)", f"""
WITH {STATES}
SELECT sample_id, step,
  round(1.0 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6)::DOUBLE AS p_max,
  round(exp(list_min(v) - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6)::DOUBLE
    AS p_min,
  round(list_sum({_softmax_sql('v')}), 6)::DOUBLE AS p_sum, layer
FROM states""")
def logit_extremes_array(spark, sf):
    s = fixtures.layer_states(spark, sf)
    pmax, pmin = softmax_extremes(F.col("values"))
    psum = F.aggregate(softmax(F.col("values")), F.lit(0.0), lambda a, x: a + x)
    return rounded(s.select("sample_id", "step", pmax.alias("p_max"), pmin.alias("p_min"), psum.alias("p_sum"),
                            "layer"))


@register("wasserstein_unequal", "V2 general form (unequal sizes, CDF gaps; prices of line n vs n+1 per supplier)", """
WITH u AS (SELECT l_suppkey || ':' || l_linenumber AS k, l_extendedprice AS x, 1 AS a, 0 AS b FROM lineitem
           UNION ALL
           SELECT l_suppkey || ':' || (l_linenumber - 1), l_extendedprice, 0, 1 FROM lineitem),
d AS (SELECT k, x, sum(a) AS da, sum(b) AS db FROM u GROUP BY k, x),
n AS (SELECT k, sum(da) AS na, sum(db) AS nb FROM d GROUP BY k HAVING sum(da) > 0 AND sum(db) > 0),
c AS (SELECT d.k, d.x, sum(da) OVER w AS ca, sum(db) OVER w AS cb, lead(d.x) OVER w AS nx, n.na, n.nb
      FROM d JOIN n USING (k) WINDOW w AS (PARTITION BY d.k ORDER BY d.x))
SELECT k AS pair_key, round(sum(CASE WHEN nx IS NULL THEN 0.0 ELSE abs(ca / na - cb / nb) * (nx - x) END), 4)::DOUBLE
  AS wasserstein FROM c GROUP BY k""")
def wasserstein_unequal(spark, sf):
    # each line is in sample "a" of (supplier, its line number) and in sample
    # "b" of (supplier, its line number - 1): every row is used twice
    li = tables.table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice")
    key = lambda n: F.concat_ws(":", F.col("l_suppkey").cast("string"), n.cast("string"))
    u = li.select(key(F.col("l_linenumber")).alias("k"), F.col("l_extendedprice").alias("x"),
                  F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        li.select(key(F.col("l_linenumber") - 1).alias("k"), F.col("l_extendedprice").alias("x"),
                  F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")))
    from ..operators.distances import wasserstein_long
    return rounded(wasserstein_long(u, "k", "x", "a", "b").withColumnRenamed("k", "pair_key"), 4)


@register("wasserstein_equal_sorted", "V2 equal-size form on sorted vectors", f"""
WITH {STATES}, p AS (SELECT sample_id, step, layer, list_sort(v) AS s FROM states),
q AS (SELECT a.sample_id, a.step, a.layer, a.s AS s1, b.s AS s2 FROM p a JOIN p b
      ON a.sample_id = b.sample_id AND a.step = b.step AND b.layer = a.layer + 1)
SELECT sample_id, step, layer,
  round(list_sum(list_transform(range(1, len(s1) + 1), lambda i: abs(s1[i] - s2[i]))) / len(s1), 6)::DOUBLE
    AS wasserstein
FROM q""")
def wasserstein_equal_sorted(spark, sf):
    s = fixtures.layer_states(spark, sf).withColumn("s", F.array_sort("values"))
    w = Window.partitionBy("sample_id", "step").orderBy("layer")
    s = s.withColumn("s2", F.lead("s").over(w)).withColumn("nl", F.lead("layer").over(w))
    s = s.filter(F.col("nl") == F.col("layer") + 1)
    return rounded(s.select("sample_id", "step", "layer", wasserstein_sorted(F.col("s"), F.col("s2")).alias("wasserstein")))

"""Score, binary-label and evaluation-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import report, scores
from ..sources import tables
from .registry import register, rounded

SCORES = """sc AS (
  SELECT l.doc_id AS id, (d.n_chars % 100) / 100.0 AS score FROM labels l JOIN documents d USING (doc_id)
  UNION ALL
  SELECT l.doc_id, ((d.n_chars * 7) % 100) / 100.0 FROM labels l JOIN documents d USING (doc_id))"""

PRED = """pr AS (SELECT doc_id AS id, quality AS y, ((doc_id * 37) % 101) / 101.0 AS score,
                   CAST(((doc_id * 37) % 101) / 101.0 > 0.5 AS INTEGER) AS pred FROM labels)"""


def _scores(spark, sf):
    lab = tables.table(spark, sf, "labels").select("doc_id")
    d = tables.table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(d, "doc_id")
    a = j.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100.0).alias("score"))
    b = j.select(F.col("doc_id").alias("id"), ((F.col("n_chars") * 7 % 100) / 100.0).alias("score"))
    return a.unionByName(b)


def _pred(spark, sf):
    lab = tables.table(spark, sf, "labels").select("doc_id", "quality")
    s = (F.col("doc_id") * 37 % 101) / 101.0
    return lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), s.alias("score"),
                      (s > 0.5).cast("int").alias("pred"))


@register("best_scores", "A18 C15 (numeric max per id; both label rules)", f"""
WITH {SCORES}, b AS (SELECT id, max(score)::DOUBLE AS best_score FROM sc GROUP BY id)
SELECT id, round(best_score, 6) AS best_score, CASE WHEN best_score > 0.5 THEN 0 ELSE 1 END AS label_v1,
       CASE WHEN best_score < 0.5 THEN 1 ELSE 0 END AS label_v2 FROM b""")
def best_scores(spark, sf):
    b = scores.best_score(_scores(spark, sf))
    return rounded(b.select("id", "best_score", scores.label_v1(F.col("best_score")).alias("label_v1"),
                            scores.label_v2(F.col("best_score")).alias("label_v2")))


@register("score_summary", "A21 A22 (mean score, label rate, positive weight)", f"""
WITH {SCORES}, b AS (SELECT id, max(score)::DOUBLE AS s FROM sc GROUP BY id),
l AS (SELECT s, CASE WHEN s < 0.5 THEN 1 ELSE 0 END AS y FROM b)
SELECT round(avg(s), 6) AS mean_score, round(avg(y), 6)::DOUBLE AS label_rate, count(*) AS n,
       round(count(*) / (2.0 * sum(y)), 6)::DOUBLE AS pos_weight FROM l""")
def score_summary(spark, sf):
    b = scores.best_score(_scores(spark, sf)).withColumn("y", scores.label_v2(F.col("best_score")))
    s = report.score_summary(b, "best_score", "y").crossJoin(report.positive_weight(b, "y"))
    return rounded(s)


@register("binary_dataset", "J9 C16 P13 (samples joined with best scores and labels)", f"""
WITH {SCORES}, b AS (SELECT id, max(score)::DOUBLE AS s FROM sc GROUP BY id)
SELECT d.doc_id AS id, d.source AS model_name, round(b.s, 6) AS bleurt_score,
       CASE WHEN b.s < 0.5 THEN 1 ELSE 0 END AS binary_label, CAST(d.n_chars AS BIGINT) AS n_chars
FROM documents d JOIN b ON b.id = d.doc_id WHERE d.text IS NOT NULL AND d.text <> ''""")
def binary_dataset(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "n_chars")
    d = d.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    j = scores.binary_dataset(d, scores.best_score(_scores(spark, sf)), "id")
    return rounded(j.select("id", F.col("source").alias("model_name"), "bleurt_score", "binary_label", "n_chars"))


@register("token_f1_scores", "C17 F6 (default scorer: token F1 between document and paired benchmark item)", f"""
WITH nb AS (SELECT count(*) AS n FROM benchmark),
bi AS (SELECT text, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS pos FROM benchmark),
p AS (SELECT d.doc_id AS pair_id, d.text AS cand, b.text AS ref FROM documents d, nb
           JOIN bi b ON b.pos = d.doc_id % nb.n),
w AS (SELECT pair_id, 1 AS c, 0 AS r, unnest(list_filter(regexp_split_to_array(lower(cand), '[{text.PY_WS}]+'),
             lambda x: x <> '')) AS w FROM p
      UNION ALL
      SELECT pair_id, 0, 1, unnest(list_filter(regexp_split_to_array(lower(ref), '[{text.PY_WS}]+'),
             lambda x: x <> '')) FROM p),
g AS (SELECT pair_id, w, sum(c) AS nc, sum(r) AS nr FROM w GROUP BY 1, 2),
m AS (SELECT pair_id, sum(least(nc, nr)) AS m, sum(nc) + sum(nr) AS t FROM g GROUP BY 1)
SELECT p.pair_id, round(CASE WHEN coalesce(m.t, 0) > 0 THEN 2.0 * m.m / m.t ELSE 0.0 END, 6)::DOUBLE AS score
FROM p LEFT JOIN m USING (pair_id)""")
def token_f1_scores(spark, sf):
    # every document is paired with benchmark item (doc_id mod #items) in item order,
    # so every document and every item (when there are fewer items) is used
    from ..operators.samples import name_samples
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    b = name_samples(tables.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("ref")),
                     "bench", ["item_id"], idx="pos")
    n = b.agg(F.count(F.lit(1)).alias("_nb"))
    d = d.crossJoin(F.broadcast(n)).withColumn("pos", F.col("doc_id") % F.col("_nb"))
    pairs = d.join(b.select("pos", "ref"), "pos").select(F.col("doc_id").alias("pair_id"),
                                                         F.col("text").alias("cand"), "ref")
    return rounded(scores.token_f1(pairs, "pair_id", "cand", "ref"))


@register("primary_reference_pairs", "P12 (value else first alias; rows without reference dropped)", """
WITH latest AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v,
                       list_sort(list_distinct(list(o_orderstatus))) AS al FROM orders GROUP BY o_custkey),
j AS (SELECT c.c_custkey, c.c_name AS generated_description,
             CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE l.v END AS ground_truth_value,
             array_to_string(l.al, '; ') AS ground_truth_aliases
      FROM customer c LEFT JOIN latest l ON l.o_custkey = c.c_custkey)
SELECT c_custkey, generated_description, coalesce(nullif(ground_truth_value, ''),
       nullif(trim(split_part(ground_truth_aliases, ';', 1)), '')) AS reference
FROM j WHERE generated_description IS NOT NULL AND generated_description <> ''
  AND coalesce(nullif(ground_truth_value, ''), nullif(trim(split_part(ground_truth_aliases, ';', 1)), '')) IS NOT NULL""")
def primary_reference_pairs(spark, sf):
    o = tables.table(spark, sf, "orders")
    latest = o.groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("v"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("al"))
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_name")
    j = c.join(latest, c.c_custkey == latest.o_custkey, "left").select(
        "c_custkey", F.col("c_name").alias("generated_description"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("v")).alias("ground_truth_value"),
        F.array_join("al", "; ").alias("ground_truth_aliases"))
    return scores.primary_reference(j).select("c_custkey", "generated_description", "reference")


@register("prediction_confusion", "A23 M11 (full confusion grid)", f"""
WITH {PRED}, cls AS (SELECT y AS c FROM pr UNION SELECT pred FROM pr),
g AS (SELECT a.c AS y, b.c AS pred FROM cls a CROSS JOIN cls b),
n AS (SELECT y, pred, count(*) AS n FROM pr GROUP BY 1, 2)
SELECT g.y, g.pred, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (y, pred)""")
def prediction_confusion(spark, sf):
    return report.confusion(_pred(spark, sf))


@register("prediction_class_metrics", "A24 M11 (per-class precision/recall/F1/support)", f"""
WITH {PRED}, t AS (SELECT y AS cls, count(*) AS support, count_if(y = pred) AS tp FROM pr GROUP BY 1),
p AS (SELECT pred AS cls, count(*) AS pred_n FROM pr GROUP BY 1),
j AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(pred_n, 0) AS pred_n FROM t FULL JOIN p ON t.cls = p.cls),
m AS (SELECT cls, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM j)
SELECT cls, round(pr, 6)::DOUBLE AS precision, round(rc, 6)::DOUBLE AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6)::DOUBLE AS f1, support FROM m""")
def prediction_class_metrics(spark, sf):
    return rounded(report.class_metrics(_pred(spark, sf)))


@register("prediction_summary", "A24 M11 (accuracy, macro and weighted averages)", f"""
WITH {PRED}, t AS (SELECT y AS cls, count(*) AS support, count_if(y = pred) AS tp FROM pr GROUP BY 1),
p AS (SELECT pred AS cls, count(*) AS pred_n FROM pr GROUP BY 1),
j AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(pred_n, 0) AS pred_n FROM t FULL JOIN p ON t.cls = p.cls),
m AS (SELECT cls, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM j),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT round((SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) FROM pr), 6)::DOUBLE AS accuracy,
  round(avg(pr), 6)::DOUBLE AS macro_precision, round(avg(rc), 6)::DOUBLE AS macro_recall,
  round(avg(f1), 6)::DOUBLE AS macro_f1, round(sum(pr * support) / sum(support), 6)::DOUBLE AS weighted_precision,
  round(sum(rc * support) / sum(support), 6)::DOUBLE AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6)::DOUBLE AS weighted_f1 FROM f""")
def prediction_summary(spark, sf):
    return rounded(report.summary_metrics(_pred(spark, sf)))


@register("prediction_auc", "A25 (tie-aware binary AUC by rank sum)", f"""
WITH {PRED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM pr)
SELECT 1 AS grp, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
       / (count_if(y = 1) * count_if(y = 0)), 6)::DOUBLE AS auc,
       count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg FROM r""")
def prediction_auc(spark, sf):
    p = _pred(spark, sf).withColumn("grp", F.lit(1))
    return rounded(report.auc_by_group(p, "grp", "score", "y"))


@register("class_weights", "A19 A20 M7 (counts, shares and rare-class weights of toxic x quality)", """
WITH c AS (SELECT CAST(quality AS VARCHAR) || '_' || CAST(toxic AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT label, n, round(sum(n) OVER () * 1.0 / n * CASE WHEN n < sum(n) OVER () * 0.05 THEN 3.0
                  WHEN n < sum(n) OVER () * 0.10 THEN 2.0 ELSE 1.0 END, 6)::DOUBLE AS weight FROM c""")
def class_weights(spark, sf):
    lab = tables.table(spark, sf, "labels").select(
        F.concat_ws("_", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))
    return rounded(report.class_weights(lab, "label"))

"""Feature-table, training-set and learning queries."""

from __future__ import annotations

import itertools
from dataclasses import replace
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import blocks, grouped_fit, labelling, layers, learn, matching, neighbours, prep, report, traces
from ..sources import fixtures, tables
from ..functions.text import with_repetition
from ..session import materialize
from .registry import register, rounded
from .label_queries import LABELS_EXACT
from .trace_queries import PROB_TRACE

CLASSES = ["CORRECT", "CATEGORY_HALLUC", "ATTRIBUTE_HALLUC", "RELATION_HALLUC"]
FEATS = [f"f_{i}" for i in range(64)]

LEARN_SQL = """lt AS (
  SELECT vec_id, CASE WHEN x[1] > 0.2 THEN 'ATTRIBUTE_HALLUC' WHEN x[1] > 0.12 THEN 'RELATION_HALLUC'
                      WHEN x[1] > 0.03 THEN 'CATEGORY_HALLUC' ELSE 'CORRECT' END AS label, x
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"""


def learning_table(spark, sf):
    """embeddings -> (vec_id, label, f_0..f_63), all rows; classes of uneven size by the first value."""
    x = tables.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    first = F.col("x")[0]
    name = (F.when(first > 0.2, "ATTRIBUTE_HALLUC").when(first > 0.12, "RELATION_HALLUC")
            .when(first > 0.03, "CATEGORY_HALLUC").otherwise("CORRECT"))
    return x.select("vec_id", name.alias("label"), *[F.col("x")[i].alias(f) for i, f in enumerate(FEATS)])


def _split(spark, sf):
    return prep.stratified_split(learning_table(spark, sf), "vec_id", "label", 0.2, 42)


COLS = ", ".join(f"round(x[{i}] + lam * (xb[{i}] - x[{i}]), 6) AS f_{i - 1}" for i in range(1, 65))

SPLIT_SQL = f"""{LEARN_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM lt),
sp AS (SELECT vec_id, label, x, rk < ceil(n * 0.2) AS is_test FROM r)"""


@register("label_encoding", "M1 (alphabetical label index)", f"""
WITH {LEARN_SQL}
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, count(*) AS n
FROM lt GROUP BY label""")
def label_encoding(spark, sf):
    lt = prep.encode_labels(learning_table(spark, sf), "label")
    return lt.groupBy("label", "label_idx").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split", "O5 M5 (exact per-label test quota by md5 order)", f"""
WITH {SPLIT_SQL} SELECT vec_id, label, is_test FROM sp""")
def stratified_split(spark, sf):
    return _split(spark, sf).select("vec_id", "label", "is_test")


@register("balance_targets", "O7 (per-class deficit to the majority, train split)", f"""
WITH {SPLIT_SQL}, c AS (SELECT label, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)
SELECT label, n, max(n) OVER () AS target, max(n) OVER () - n AS deficit FROM c""")
def balance_targets(spark, sf):
    return prep.balance_targets(_split(spark, sf).filter(~F.col("is_test")), "label")


@register("smote_class_counts", "M6 J14 V14 O7 (class counts after SMOTE equal the majority)", f"""
WITH {SPLIT_SQL}, c AS (SELECT label, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)
SELECT label, max(n) OVER () AS n_after, max(n) OVER () - n AS n_synthetic FROM c""")
def smote_class_counts(spark, sf):
    tr = _split(spark, sf).filter(~F.col("is_test"))
    b = prep.smote(tr, "vec_id", "label", FEATS)
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n_after"),
                                  F.count_if(F.col("is_synthetic")).alias("n_synthetic"))


SMOTE_SQL = f"""
WITH {SPLIT_SQL},
tr AS (SELECT vec_id, label, x FROM sp WHERE NOT is_test),
cnt AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
tg AS (SELECT label, n, max(n) OVER () - n AS deficit FROM cnt),
kk AS (SELECT greatest(1, least(15, min(n) - 1)) AS k FROM cnt),
mi AS (SELECT tr.*, tg.n, tg.deficit FROM tr JOIN tg USING (label) WHERE tg.deficit > 0),
rk AS (SELECT mi.*, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) - 1 AS r
       FROM mi),
pr AS (SELECT a.vec_id AS a, b.vec_id AS b, b.x AS xb,
              list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d
       FROM mi a JOIN mi b ON a.label = b.label AND a.vec_id <> b.vec_id),
nn AS (SELECT a, xb, row_number() OVER (PARTITION BY a ORDER BY d, b::VARCHAR) - 1 AS nn FROM pr),
cp AS (SELECT rk.*, CAST(floor(deficit / n) + CASE WHEN r < deficit % n THEN 1 ELSE 0 END AS INTEGER) AS copies FROM rk),
sy AS (SELECT vec_id, label, x, unnest(range(0, copies)) AS j FROM cp WHERE copies > 0),
sy2 AS (SELECT sy.*,
          ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':' || CAST(j AS VARCHAR) || ':42'), 1, 8))::BIGINT % kk.k AS pick,
          ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':' || CAST(j AS VARCHAR) || ':42l'), 1, 12))::BIGINT
            / 281474976710656.0 AS lam
        FROM sy, kk)
SELECT CAST(sy2.vec_id AS VARCHAR) || '_syn_' || CAST(sy2.j AS VARCHAR) AS vec_id, sy2.label,
  """ + COLS + """, TRUE AS is_synthetic
FROM sy2 JOIN nn ON nn.a = sy2.vec_id AND nn.nn = sy2.pick"""


@register("smote_rows", "M6 J14 V14 (synthetic rows; neighbours among all rows of the class, md5-chosen neighbour and lambda)",
          SMOTE_SQL)
def smote_rows(spark, sf):
    tr = _split(spark, sf).filter(~F.col("is_test"))
    return rounded(prep.smote(tr, "vec_id", "label", FEATS).filter(F.col("is_synthetic")))


@register("neighbour_recall", "J14 V14 (share of the true 15 nearest rows that the projection forest finds, for ids divisible by 100)")
def neighbour_recall(spark, sf, k: int = 15):
    """Queries, their true neighbours among all rows (by brute force), those found, and the recall.  All rows are one class."""
    e = tables.table(spark, sf, "embeddings")
    rows = materialize(e.select(F.col("vec_id").cast("string").alias("id"), F.lit("all").alias("label"),
                                F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 100 == 0).alias("asks")))
    found = neighbours.nearest(rows, k, asks="asks")
    true = neighbours.nearest_of_all(rows, rows.filter("asks"), k)
    hit = true.select("a", "b").join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    return rounded(hit.agg(F.count_distinct("a").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"),
                           (F.count("hit") / F.count(F.lit(1))).alias("recall")))


@register("scaled_features", "V12 (population-std scaling fit on train, applied to all)", f"""
WITH {SPLIT_SQL}, st AS (SELECT """ + ", ".join(
    f"avg(x[{i + 1}]) AS m{i}, stddev_pop(x[{i + 1}]) AS s{i}" for i in range(64)) + """ FROM sp WHERE NOT is_test)
SELECT vec_id, is_test, """ + ", ".join(
    f"round((x[{i + 1}] - m{i}) / CASE WHEN s{i} = 0 THEN 1.0 ELSE s{i} END, 6) AS f_{i}" for i in range(64)) + """
FROM sp, st""")
def scaled_features(spark, sf):
    sp = _split(spark, sf)
    st = prep.fit_scaler(sp.filter(~F.col("is_test")), FEATS)
    return rounded(prep.apply_scaler(sp, st, FEATS).select("vec_id", "is_test", *FEATS))


@register("list_feature_parse", "V9 S12 (list-valued features written as text and parsed back)", f"""
WITH {PROB_TRACE}
SELECT sample_id, round(avg(p_max), 6) AS feature_60, round(avg(p_min), 6) AS feature_61,
       round(count(*)::DOUBLE, 6) AS n_parsed FROM prob_trace GROUP BY sample_id""")
def list_feature_parse(spark, sf):
    lists = feat.to_csv_row(traces.trace_arrays(fixtures.prob_trace(spark, sf)))
    return rounded(lists.select("sample_id", feat.parse_feature(F.col("feature_60")).alias("feature_60"),
                                feat.parse_feature(F.col("feature_61")).alias("feature_61"),
                                feat.parse_feature(F.size(F.from_json("feature_60", "array<double>"))
                                                   .cast("string")).alias("n_parsed")))


@register("composite_features", "V10 M2 (squares, products and the perplexity composite)", f"""
WITH {PROB_TRACE}, c AS (
  SELECT sample_id, avg(1.0::DOUBLE / greatest(p_max, 1e-10)) AS f66,
         stddev_pop(1.0::DOUBLE / greatest(p_max, 1e-10)) AS f67,
         coalesce(regr_slope(p_max, step::DOUBLE), 0.0::DOUBLE) AS f68, avg(p_max) AS f69
  FROM prob_trace GROUP BY sample_id)
SELECT sample_id, round(f67 * f67, 4) AS feature_67_squared, round(f66 * f66, 4) AS feature_66_squared,
       round(f67 * f69, 6) AS feature_67_x_69, round(f67 * f68, 6) AS feature_67_x_68,
       round((f67 + f69 + f68 + f66) / 4.0, 6) AS perplexity_composite FROM c""")
def composite_features(spark, sf):
    c = feat.add_composites(traces.confidence_block(fixtures.prob_trace(spark, sf)))
    r6 = rounded(c.select("sample_id", "feature_67_x_69", "feature_67_x_68", "perplexity_composite"))
    r4 = rounded(c.select("sample_id", "feature_67_squared", "feature_66_squared"), 4)
    return r4.join(r6, "sample_id")


def _feature_rows(spark, sf):
    """One row per events sample; blocks from every signal family."""
    t = fixtures.prob_trace(spark, sf)
    samples = t.select("sample_id").distinct()
    states = fixtures.layer_states(spark, sf)
    attn = fixtures.attention_states(spark, sf)
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    repeated = ("feature_71", "feature_72", "feature_73")
    blocks = [layers.layer_shift(states, "llm", 0), layers.layer_shift(attn, "llm", 30),
              layers.step_consistency(states, "llm"), layers.attention_concentration(attn),
              traces.confidence_block(t),
              with_repetition(docs, "text", repeated).select("sample_id", *repeated, F.col("text").alias("generated_description"))]
    names = samples.select("sample_id", F.concat(F.lit("sample_"), F.col("sample_id").cast("string")).alias("image_name"),
                           F.concat(F.lit("sample_"), F.col("sample_id").cast("string"), F.lit(".txt")).alias("image_filename"),
                           F.concat(F.lit("sample_"), F.col("sample_id").cast("string")).alias("image_path"))
    return feat.assemble(names, blocks, lists=traces.trace_arrays(t), required=docs.select("sample_id"))


def _feature_rows_sql() -> str:
    """Each block's own oracle query as a subquery, left-joined to the samples."""
    from .registry import all_queries
    from .vector_queries import STATES, _shift_sql, _wide_sql
    q = {n: v.sql for n, v in all_queries().items()}
    hidden = f"WITH {STATES}, {_shift_sql(0)}\n{_wide_sql(0)}"
    blocks = [hidden, q["attention_layer_shift"], q["step_consistency"], q["attention_concentration"],
              q["trace_confidence_block"]]
    joins = "\n".join(f"LEFT JOIN ({b}) b{i} USING (sample_id)" for i, b in enumerate(blocks))
    rep = ("SELECT doc_id AS sample_id, feature_71, feature_72, feature_73 FROM ("
           + q["text_repetition"] + ") r")
    feats = []
    for i in range(74):
        if i in (60, 61):
            feats.append(f"CASE WHEN d.sample_id IS NULL THEN []::DOUBLE[] ELSE coalesce(tl.feature_{i}, []::DOUBLE[]) "
                         f"END AS feature_{i}")
        else:
            feats.append(f"CASE WHEN d.sample_id IS NULL THEN 0.0 ELSE round(coalesce(feature_{i}, 0.0), 6) END::DOUBLE "
                         f"AS feature_{i}")
    return f"""
WITH s AS (SELECT DISTINCT user_id AS sample_id FROM events),
d AS (SELECT doc_id AS sample_id, text FROM documents),
tl AS ({q["trace_lists"]}),
rp AS ({rep})
SELECT s.sample_id, {", ".join(feats)},
  'sample_' || CAST(s.sample_id AS VARCHAR) AS image_name,
  'sample_' || CAST(s.sample_id AS VARCHAR) || '.txt' AS image_filename,
  'sample_' || CAST(s.sample_id AS VARCHAR) AS image_path,
  coalesce(d.text, '') AS generated_description, d.sample_id IS NULL AS is_failed
FROM s {joins}
LEFT JOIN rp USING (sample_id) LEFT JOIN tl USING (sample_id) LEFT JOIN d USING (sample_id)"""


@register("feature_rows", "V16 P15 S12 (74 features + metadata per sample; missing -> zeros, is_failed)",
          _feature_rows_sql())
def feature_rows(spark, sf):
    r = _feature_rows(spark, sf)
    rnd = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return rounded(r.withColumns({"feature_60": rnd(F.col("feature_60")), "feature_61": rnd(F.col("feature_61"))}))


def _sample_signals(spark, sf, texts):
    """``texts`` with their order's customer and priority and the customer's 74 features; absent ones become zeros.

    Whole texts meet orders and features, before they become chunks: no chunk is shuffled.
    """
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_custkey",
                                                 F.col("o_orderpriority").alias("model_name"))
    fr = _feature_rows(spark, sf).drop("generated_description", "is_failed", "image_name", "image_filename",
                                       "image_path").withColumnRenamed("sample_id", "o_custkey")
    d = texts.join(o, "sample_id", "left").join(fr, "o_custkey", "left")
    filled = {f"feature_{i}": (F.to_json(F.coalesce(F.col(f"feature_{i}"), F.array().cast("array<double>")))
                               if i in (60, 61) else F.coalesce(F.col(f"feature_{i}"), F.lit(0.0)))
              for i in range(74)}
    return d.withColumns(filled)


def chunk_dataset(spark, sf, fuzzy=True):
    """Labelled chunks + chunk features + the sample's 74 features.

    Chunk samples are orders; their signal features are the customer's
    (orders.o_custkey = feature sample id), absent ones become zeros.
    """
    from ..operators import chunks as chunk_ops
    li = labelling.prepare(fixtures.generations(spark, sf), fixtures.references(spark, sf))
    signals = tuple(f"feature_{i}" for i in range(74))
    d = _sample_signals(spark, sf, li.texts)
    lab = matching.labelled_texts(d, li.text_col, fuzzy=fuzzy, keep=(li.text_col, "o_custkey", "model_name", *signals))
    cf = chunk_ops.chunk_features(lab, keep=("o_custkey", "model_name", *signals))
    mine = [c for c in cf.columns if c not in ("o_custkey", "sample_id", "model_name", *signals)]
    return cf.select("o_custkey", "sample_id", *mine, "model_name", *signals)


def _matrix_samples(spark, sf, fuzzy=True, filled=False):
    """Samples with their matrix columns once (``signals``) and their labelled ``chunks`` with the chunk columns; those columns and all, in matrix order.

    The signals are parsed and combined per sample, not per chunk; with ``filled``, null and the NaN of an empty list count as 0.
    """
    li = labelling.prepare(fixtures.generations(spark, sf), fixtures.references(spark, sf))
    d = feat.preprocess(_sample_signals(spark, sf, li.texts), "multiclass")
    own = feat.CHUNK_FEATURES
    cols = feat.matrix_columns(SimpleNamespace(columns=[*own, *d.columns]))
    signals = [_filled(c) if filled else F.col(c).cast("double") for c in cols if c not in own]
    d = d.select("sample_id", "model_name", li.text_col, "gt_texts", F.array(*signals).alias("signals"))
    return matching.labelled_texts(d, li.text_col, fuzzy=fuzzy, fields=("chunk_label", *own), keep=("model_name", "signals")), own, cols


@register("chunk_dataset", "C13 (chunks + labels + chunk features + 74 sample features)")
def chunk_dataset_q(spark, sf):
    return chunk_dataset(spark, sf)


@register("multiclass_matrix", "M2 M4 P7 V9 V10 (preprocessed multi-class matrix, 92 columns)")
def multiclass_matrix(spark, sf):
    d, own, cols = _matrix_samples(spark, sf)
    d = d.select("sample_id", "signals", F.posexplode_outer("chunks").alias("chunk_idx", "_c")).filter("chunk_idx IS NOT NULL")
    # the columns in matrix order, by runs of the sample's and of the chunk's
    at, parts = 0, []
    for mine, run in itertools.groupby(cols, lambda c: c in own):
        run = [*run]
        parts.append(F.array(*[F.col("_c")[c] for c in run]) if mine else F.slice("signals", at + 1, len(run)))
        at += 0 if mine else len(run)
    return d.select("sample_id", "chunk_idx", F.col("_c.chunk_label").alias("chunk_label"), F.concat(*parts).alias("x"), F.lit(len(cols)).alias("n_columns"))


def _binary_matrix_sql() -> str:
    base = _feature_rows_sql()
    def col(i):
        if i in (60, 61):
            # the list text parses back to its mean; an empty list is NaN
            return (f"CASE WHEN len(feature_{i}) = 0 THEN 'nan'::DOUBLE "
                    f"ELSE round(list_sum(feature_{i}) / len(feature_{i}), 6) END")
        return f"feature_{i}"
    xb = ", ".join(col(i) for i in list(range(62)) + [68, 69, 71])
    xs = ", ".join(col(i) for i in range(62))
    return f"SELECT sample_id, [{xb}] AS x_binary, [{xs}] AS x_base FROM ({base}) fr"


@register("binary_matrix", "M3 P9 P8 V9 (binary and base feature sets; list features parsed to their mean)",
          _binary_matrix_sql())
def binary_matrix(spark, sf):
    r = _feature_rows(spark, sf)
    rnd = lambda c: F.transform(c, lambda x: F.round(x, 6))
    fr = feat.to_csv_row(r.withColumns({"feature_60": rnd(F.col("feature_60")),
                                        "feature_61": rnd(F.col("feature_61"))}))
    b = feat.preprocess(fr, "binary")
    base = feat.selected_features("base", b.columns)
    arr = lambda cols: rnd(F.array(*[F.col(c).cast("double") for c in cols]))
    return b.select("sample_id", arr(feat.matrix_columns(b, "binary")).alias("x_binary"), arr(base).alias("x_base"))


def _train_eval(spark, sf):
    sp = prep.encode_labels(_split(spark, sf), "label")
    tr = sp.filter(~F.col("is_test"))
    st = prep.fit_scaler(tr, FEATS)
    trs = prep.with_class_weights(prep.apply_scaler(tr, st, FEATS), "label")
    te = prep.apply_scaler(sp.filter(F.col("is_test")), st, FEATS)
    model = learn.fit(trs, FEATS, "label_idx", "weight", max_iter=50)
    return model, te


@register("train_predict", "M7 M8 M10 (weighted multinomial fit on train; test predictions)")
def train_predict(spark, sf):
    model, te = _train_eval(spark, sf)
    return learn.predict(model, te, FEATS, ["vec_id", "label", "label_idx"])


@register("evaluation_report", "M11 A23 A24 A25 (confusion, metrics and one-vs-rest AUC of the model)")
def evaluation_report(spark, sf):
    model, te = _train_eval(spark, sf)
    p = learn.predict(model, te, FEATS, ["vec_id", F.col("label_idx").alias("y")])
    s = report.summary_metrics(p)
    longp = p.select("vec_id", "y", F.posexplode("probs").alias("cls", "prob"))
    per, avg = report.auc_one_vs_rest(longp)
    return s.crossJoin(avg)


@register("permutation_importance", "M12 M13 O4 O6 A26 (all columns scored in one job; group shares)")
def permutation_importance(spark, sf):
    model, te = _train_eval(spark, sf)
    imp = learn.permutation_importance(model, te, FEATS, "vec_id", "label_idx")
    top = report.top_importance(imp, 20)
    groups = report.importance_groups(imp)
    return top.select("rank", "feature", "importance").unionByName(
        groups.select(F.lit(None).cast("int").alias("rank"), F.col("group").alias("feature"), "importance"))


@register("run_summary", "A27 M14 (per model x dataset totals and label mix, exact rules)", LABELS_EXACT + """
SELECT o.o_orderpriority AS model_name, o.o_orderstatus AS dataset, count(*) AS total_chunks,
       count(DISTINCT l.sample_id) AS total_samples,
       round(avg(CASE WHEN l.chunk_label = 'CORRECT' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS correct_rate
FROM labels l JOIN orders o ON o.o_orderkey = l.sample_id GROUP BY 1, 2""")
def run_summary(spark, sf):
    li = labelling.prepare(fixtures.generations(spark, sf), fixtures.references(spark, sf))
    lab = matching.with_labels(li.samples, fuzzy=False).select("sample_id", F.col("chunks")["chunk_label"].alias("labels"))
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"),
                                                 F.col("o_orderpriority").alias("model_name"),
                                                 F.col("o_orderstatus").alias("dataset"))
    # a row per sample meets its order, not a row per chunk
    rows = lab.join(o, "sample_id").select("sample_id", "model_name", "dataset", F.explode("labels").alias("chunk_label"))
    return rounded(report.run_summary(rows, "model_name", "dataset", "chunk_label"))


@register("grouped_newton_step", "M14 (first Newton step of every group's model, from coefficients zero)", f"""
WITH {LEARN_SQL},
d AS (SELECT vec_id % 5 AS g, CAST(x[1] > 0.05 AS INTEGER) - 0.5 AS r, x[2] AS a, x[3] AS b FROM lt),
s AS (SELECT g, sum(r * a) AS ga, sum(r * b) AS gb, sum(r) AS gc, sum(a * a) / 4 AS aa, sum(a * b) / 4 AS ab, sum(a) / 4 AS ac,
             sum(b * b) / 4 AS bb, sum(b) / 4 AS bc, count(*) / 4 AS cc FROM d GROUP BY g),
t AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s)
SELECT CAST(g AS VARCHAR) AS g, round((ga * (bb * cc - bc * bc) - ab * (gb * cc - bc * gc) + ac * (gb * bc - bb * gc)) / det, 4) AS beta_a,
       round((aa * (gb * cc - bc * gc) - ga * (ab * cc - bc * ac) + ac * (ab * gc - gb * ac)) / det, 4) AS beta_b,
       round((aa * (bb * gc - gb * bc) - ab * (ab * gc - gb * ac) + ga * (ab * bc - bb * ac)) / det, 4) AS beta_c
FROM t""")
def grouped_newton_step(spark, sf):
    d = learning_table(spark, sf).select((F.col("vec_id") % 5).alias("g"), (F.col("f_0") > 0.05).cast("int").alias("y"), "f_1", "f_2")
    rows = grouped_fit.design(d, "g", ["f_1", "f_2"], "y")
    after = grouped_fit.step(rows, materialize(grouped_fit.start(rows)))
    return rounded(after.select("g", *[F.col("beta")[i].alias(f"beta_{c}") for i, c in enumerate("abc")]), 4)


@register("model_comparison", "M14 A27 (a model per dataset group, stepped together)")
def model_comparison(spark, sf):
    sp = prep.encode_labels(_split(spark, sf), "label")
    sp = sp.withColumn("dataset", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))
    sp = prep.with_class_weights(sp, "label")
    return learn.compare_models(sp, "dataset", FEATS)


def _filled(c: str) -> F.Column:
    """A matrix value as double; null and the NaN of an empty list count as 0."""
    return F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)


def _chunk_matrix(spark, sf, fuzzy=True):
    """The multi-class chunk matrix in blocks with its label, split by sample, and its columns."""
    d, own, cols = _matrix_samples(spark, sf, fuzzy, filled=True)
    d = prep.stratified_split(d, "sample_id", "model_name", group="sample_id")
    chunks = F.col("chunks").cast(f"array<struct<label:string,{','.join(f'{c}:double' for c in own)}>>")
    m = blocks.pack(d.select(F.col("sample_id").alias("id"), F.col("model_name").alias("group"), "is_test", F.col("signals").alias("shared"), chunks.alias("chunks")),
                    sorted(matching.LABELS), [c for c in cols if c not in own], own, cols)
    return prep.encode_labels(m, "label"), cols


def _scaled_and_weighted(split, cols):
    """Training and test rows, scaled by the training rows' statistics, training rows with class weights."""
    scaled = prep.apply_scaler(split, prep.fit_scaler(split.side(False), cols), cols)
    return prep.with_class_weights(scaled.side(False), "label"), scaled.side(True)


def _chunk_model(spark, sf):
    split, cols = _chunk_matrix(spark, sf)
    train, test = _scaled_and_weighted(split, cols)
    return learn.fit(train, cols, "label_idx", "weight", max_iter=50), train, test, cols


@register("chunk_train_predict", "M2 M4 M5 M7 M8 M10 V13 (weighted fit on the chunk matrix, split by sample; test predictions)")
def chunk_train_predict(spark, sf):
    model, _, test, cols = _chunk_model(spark, sf)
    return learn.predict(model, test, cols, ["row_id", "label", "label_idx"])


@register("chunk_evaluation_report", "M11 A24 A25 (metrics of the chunk model on its test samples)")
def chunk_evaluation_report(spark, sf):
    model, train, test, cols = _chunk_model(spark, sf)
    p = learn.predict(model, test, cols, ["y"])
    _, auc = report.auc_one_vs_rest(p.select("y", F.posexplode("probs").alias("cls", "prob")))
    sizes = train.size("n_train").crossJoin(test.size("n_test"))
    return sizes.crossJoin(report.summary_metrics(p)).crossJoin(auc)


@register("chunk_importance", "M12 M13 O4 O6 A26 (importance of the chunk matrix's columns: top 20, top 10 of 62-73, group shares)")
def chunk_importance(spark, sf):
    model, _, test, cols = _chunk_model(spark, sf)
    return report.importance_report(materialize(learn.permutation_importance(model, test, cols, "row_id", "label_idx")))


@register("chunk_model_comparison", "M14 A27 (a chunk model per model name, stepped together)")
def chunk_model_comparison(spark, sf):
    split, cols = _chunk_matrix(spark, sf)
    scaled = prep.apply_scaler(split, prep.fit_scaler(split.side(False), cols), cols)
    weights = prep.with_class_weights(scaled.side(False), "label").weights
    return learn.compare_models(replace(scaled, weights=weights), "model_name", cols)


SPLIT_CHUNKS_EXACT = LABELS_EXACT + """
, sp AS (SELECT chunk_label AS label, sample_id,
                ('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':42'), 1, 12))::BIGINT / 281474976710656.0 < 0.2 AS is_test FROM labels)"""


def _balanced_chunks(spark, sf, fuzzy):
    """The chunk matrix split by sample, its training side balanced before any scaling (M6)."""
    split, cols = _chunk_matrix(spark, sf, fuzzy)
    synthetic = prep.smote(split.side(False).table().select("row_id", "label", *cols), "row_id", "label", cols)
    return materialize(synthetic), split.side(True).table(), cols


@register("chunk_smote_counts", "M6 M5 (training chunks balanced before scaling: class counts, exact rules)", SPLIT_CHUNKS_EXACT + """
, c AS (SELECT label, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)
SELECT label, max(n) OVER () AS n_after, max(n) OVER () - n AS n_synthetic FROM c""")
def chunk_smote_counts(spark, sf):
    balanced, _, _ = _balanced_chunks(spark, sf, fuzzy=False)
    return balanced.groupBy("label").agg(F.count(F.lit(1)).alias("n_after"), F.count_if(F.col("is_synthetic")).alias("n_synthetic"))


@register("chunk_smote_evaluation", "M6 M8 M11 (chunk model fitted on the balanced, then scaled training side; metrics on its test samples)")
def chunk_smote_evaluation(spark, sf):
    balanced, test, cols = _balanced_chunks(spark, sf, fuzzy=True)
    stats = prep.fit_scaler(balanced, cols)
    index = test.select("label", "label_idx").distinct()  # a row per class
    train = prep.apply_scaler(balanced.join(F.broadcast(index), "label"), stats, cols)
    model = learn.fit(materialize(train), cols, "label_idx", None, max_iter=50)
    p = learn.predict(model, prep.apply_scaler(test, stats, cols), cols, [F.col("label_idx").alias("y")])
    sizes = train.agg(F.count(F.lit(1)).alias("n_train")).crossJoin(test.agg(F.count(F.lit(1)).alias("n_test")))
    return sizes.crossJoin(report.summary_metrics(p))


@register("chunk_split_counts", "M5 M7 A19 A20 (chunks split by sample, counts and class weights of the training side, exact rules)",
          SPLIT_CHUNKS_EXACT + """,
c AS (SELECT label, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test,
             count(DISTINCT sample_id) FILTER (is_test) AS test_samples FROM sp GROUP BY label),
t AS (SELECT sum(n_train) AS total FROM c)
SELECT label, n_train, n_test, test_samples,
       round(CASE WHEN n_train > 0 THEN total / n_train * CASE WHEN n_train < total * 0.05 THEN 3.0 WHEN n_train < total * 0.10 THEN 2.0
             ELSE 1.0 END END, 6)::DOUBLE AS weight FROM c, t""")
def chunk_split_counts(spark, sf):
    li = labelling.prepare(fixtures.generations(spark, sf), fixtures.references(spark, sf))
    lab = labelling.label(li, fuzzy=False).select("sample_id", "chunk_idx", F.col("chunk_label").alias("label"))
    sp = prep.stratified_split(lab, "chunk_idx", "label", group="sample_id")
    c = sp.groupBy("label").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"),
                                F.count_distinct(F.when(F.col("is_test"), F.col("sample_id"))).alias("test_samples"))
    c = materialize(c)  # a row per class: the weights follow from the counts, so that the chunks are labelled once
    w = report.weights_of_counts(c.filter("n_train > 0").select("label", F.col("n_train").alias("n")), "label").select("label", "weight")
    return rounded(c.join(w, "label", "left"))


@register("chunk_weighted_copies", "M8 M7 (training chunks repeated by class weight for the network: rows per class, exact rules)", SPLIT_CHUNKS_EXACT.replace(
    "sample_id,\n                ('0x'", "sample_id, CAST(sample_id AS VARCHAR) || '_' || CAST(chunk_idx AS VARCHAR) AS row_id,\n                ('0x'") + """
, c AS (SELECT label, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label),
w AS (SELECT label, n, sum(n) OVER () / n * CASE WHEN n < sum(n) OVER () * 0.05 THEN 3.0 WHEN n < sum(n) OVER () * 0.10 THEN 2.0 ELSE 1.0 END AS weight FROM c),
r AS (SELECT label, n, round(weight / min(weight) OVER (), 9) AS ratio FROM w)
SELECT sp.label, r.n AS n_rows, sum(floor(ratio) + CASE WHEN ('0x' || substr(md5(row_id || ':42w'), 1, 12))::BIGINT / 281474976710656.0 < ratio - floor(ratio)
       THEN 1 ELSE 0 END)::BIGINT AS n_copies
FROM sp JOIN r USING (label) WHERE NOT is_test GROUP BY sp.label, r.n""")
def chunk_weighted_copies(spark, sf):
    li = labelling.prepare(fixtures.generations(spark, sf), fixtures.references(spark, sf))
    lab = labelling.label(li, fuzzy=False).select("sample_id", F.concat_ws("_", "sample_id", "chunk_idx").alias("row_id"), F.col("chunk_label").alias("label"))
    train = materialize(prep.stratified_split(lab, "row_id", "label", group="sample_id").filter(~F.col("is_test")).select("row_id", "label"))
    train = prep.with_class_weights(train, "label")
    copies = prep.weighted_copies(train, "row_id", "weight").groupBy("label").agg(F.count(F.lit(1)).alias("n_copies"))
    return train.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).join(copies, "label")


@register("chunk_network_evaluation", "M8 M7 M10 M11 (the deep network on the chunk matrix, classes weighted; metrics on its test samples)")
def chunk_network_evaluation(spark, sf):
    split, cols = _chunk_matrix(spark, sf)
    train, test = (m.table() for m in _scaled_and_weighted(split, cols))
    model = learn.fit(train, cols, "label_idx", "weight", max_iter=30, mlp_layers=learn.NETWORK_LAYERS, id_col="row_id")
    p = learn.predict(model, test, cols, [F.col("label_idx").alias("y")])
    return report.summary_metrics(p)


def _binary_split(spark, sf):
    """Binary matrix rows with their label (1: quality 0, the class to be found), split by quota."""
    names = [f"x_{i}" for i in range(65)]
    x = binary_matrix(spark, sf).select("sample_id", *[F.col("x_binary")[i].alias(c) for i, c in enumerate(names)])
    x = x.select("sample_id", *[_filled(c) for c in names])
    truth = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 0).cast("int").alias("label"))
    return prep.stratified_split(materialize(x.join(truth.filter("label IS NOT NULL"), "sample_id")), "sample_id", "label", 0.2, 42), names


@register("binary_label_counts", "M9 A21 M5 (binary labels of the fit: classes on both sides and the positive weight)", """
WITH d AS (SELECT s.sample_id, CAST(l.quality = 0 AS INTEGER) AS label FROM (SELECT DISTINCT user_id AS sample_id FROM events) s
           JOIN labels l ON l.doc_id = s.sample_id WHERE l.quality IS NOT NULL),
sp AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) - 1
                < ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM d),
c AS (SELECT count(*) FILTER (NOT is_test AND label = 1) AS train_positive, count(*) FILTER (NOT is_test AND label = 0) AS train_negative,
             count(*) FILTER (is_test AND label = 1) AS test_positive, count(*) FILTER (is_test AND label = 0) AS test_negative FROM sp)
SELECT *, round((train_positive + train_negative) / (2.0 * train_positive), 6)::DOUBLE AS pos_weight FROM c""")
def binary_label_counts(spark, sf):
    d, _ = _binary_split(spark, sf)
    n = lambda test, label: F.count_if((F.col("is_test") == test) & (F.col("label") == label))
    c = d.agg(n(False, 1).alias("train_positive"), n(False, 0).alias("train_negative"), n(True, 1).alias("test_positive"), n(True, 0).alias("test_negative"))
    return rounded(c.crossJoin(report.positive_weight(d.filter(~F.col("is_test")), "label")))


@register("binary_model_report", "M3 M9 A21 A24 A25 (binary fit with the positive weight on the binary matrix)")
def binary_model_report(spark, sf):
    d, names = _binary_split(spark, sf)
    pos = report.positive_weight(d.filter(~F.col("is_test")), "label")
    d = d.crossJoin(F.broadcast(pos)).withColumn("weight", F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(F.lit(1.0)))
    train = d.filter(~F.col("is_test"))
    d = materialize(prep.apply_scaler(d, prep.fit_scaler(train, names), names))
    model = learn.fit(d.filter(~F.col("is_test")), names, "label", "weight", family="binomial", max_iter=50, reg=0.01)
    p = learn.predict(model, d.filter(F.col("is_test")), names, [F.col("label").alias("y")])
    _, auc = report.auc_one_vs_rest(p.select("y", F.posexplode("probs").alias("cls", "prob")))
    return report.summary_metrics(p).crossJoin(auc).crossJoin(pos)

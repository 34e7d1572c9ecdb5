"""Logical input tables derived from the driver tables.

The audit operators read model-signal tables (``prob_trace``, ``logits``,
``hidden_states``, ``attentions``, ``tokens``, truth tables...).  In
production those are written by whatever ran the model; here every one is a
Spark projection of the given parquet tables, so its size grows with them.
The rules are the bindings listed in FIXTURES.md part B.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import ordered_index
from .tables import table


def prob_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, step, p_max, p_min) from ``events``.

    sample = user, step = position by (ts, event_id), p_max = 1/(1+value),
    p_min = p_max / (2 + event_id % 7).
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ev = ordered_index(ev, "user_id", ["ts", "event_id"], out="step")
    p_max = F.lit(1.0) / (F.lit(1.0) + F.col("value"))
    return ev.select(
        F.col("user_id").alias("sample_id"),
        F.col("step"),
        p_max.alias("p_max"),
        (p_max / (F.lit(2) + F.col("event_id") % 7)).alias("p_min"),
    )


def trace_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared prompt / generation lengths per sample for the perplexity ratio.

    prompt_len = user_id % 11, gen_len = steps - prompt_len (floored at 0).
    """
    ev = table(spark, sf_dir, "events").select("user_id")
    n = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("user_id").alias("sample_id"),
                    (F.col("user_id") % 11).cast("int").alias("prompt_len"),
                    F.greatest(F.col("n") - F.col("user_id") % 11, F.lit(0)).cast("int").alias("gen_len"))


def logits_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form logits: (sample_id, step, logit) from ``lineitem``.

    sample = l_suppkey, step = l_linenumber, one vocabulary entry per line,
    logit = l_quantity / 10.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity")
    return li.select(F.col("l_suppkey").alias("sample_id"),
                     F.col("l_linenumber").alias("step"),
                     (F.col("l_quantity") / 10.0).alias("logit"))


def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array-form states (sample_id, step, layer, values) from ``embeddings``.

    sample = vec_id div 20, step = (vec_id % 20) div 5, layer = vec_id % 5.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select((F.col("vec_id") / 20).cast("long").alias("sample_id"),
                    ((F.col("vec_id") % 20) / 5).cast("int").alias("step"),
                    (F.col("vec_id") % 5).cast("int").alias("layer"),
                    F.col("embedding").alias("values"))


def attention_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention rows: softmax of each embedding, read as 4 heads x 16."""
    from ..functions.arrays import softmax
    s = layer_states(spark, sf_dir)
    return s.select("sample_id", "step", "layer", F.lit(4).alias("n_heads"),
                    softmax(F.col("values")).alias("values"))


# --- ground truth (orders / lineitem / part / customer) ----------------------
ANN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images: one per order; every 7th has an id that no annotation names (-key)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.select(F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"),
                    F.concat(F.lit("img_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"))


def coco_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption annotations: one per line item, caption = part name."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *ANN_ORDER)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("caption"))
    return li.join(p, "l_partkey").withColumnRenamed("l_orderkey", "image_id")


def coco_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance annotations: category = part, bbox from quantities, area = price."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *ANN_ORDER)
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"),
                     F.array("l_quantity", "l_discount", "l_tax").alias("bbox"),
                     F.col("l_extendedprice").alias("area"), *ANN_ORDER)


def coco_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories: one per part; every 10th has an id that no annotation names (-key), so the default name is used."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select(F.when(F.col("p_partkey") % 10 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"))


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows keyed by image file name: one per order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey").cast("string")
    return o.select(F.concat(F.lit("img_"), k).alias("image_name"),
                    F.concat(F.lit("img_"), k, F.lit(".jpg")).alias("image_filename"))


# --- generated descriptions and reference captions (lineitem x part) ---------
# Sentence templates by line number % 4, {p} = this line's part name,
# {q} = the next line's part name on the same side (generated / reference).
SENTENCES = ["A {p} on a {q}.", "The {p} holding the {q}.", "One {p} beside a {q}.", "A {p}."]


def _sentences(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """``only`` (sample_id, a small table) leaves the lines of its orders alone."""
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *ANN_ORDER)
    if only is not None:
        li = li.join(F.broadcast(only.select(F.col("sample_id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    d = li.join(p, "l_partkey").withColumn("side", F.when(F.col("l_suppkey") % 2 == 0, "gen").otherwise("gt"))
    d = d.repartition("l_orderkey")  # serves the window and what groups by order
    w = Window.partitionBy("l_orderkey", "side").orderBy(*ANN_ORDER)
    d = d.withColumn("q", F.lead("p_name").over(w)).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    q = F.coalesce(F.col("q"), F.col("p_name"))
    tpl = F.col("l_linenumber") % 4
    s = (F.when(tpl == 0, F.concat(F.lit("A "), F.col("p_name"), F.lit(" on a "), q, F.lit(".")))
          .when(tpl == 1, F.concat(F.lit("The "), F.col("p_name"), F.lit(" holding the "), q, F.lit(".")))
          .when(tpl == 2, F.concat(F.lit("One "), F.col("p_name"), F.lit(" beside a "), q, F.lit(".")))
          .otherwise(F.concat(F.lit("A "), F.col("p_name"), F.lit("."))))
    return d.select(F.col("l_orderkey").alias("sample_id"), "side", "pos", s.alias("sentence"))


def generations(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(sample_id, generated_description): the order's generated sentences joined by spaces."""
    s = _sentences(spark, sf_dir, only).filter(F.col("side") == "gen")
    g = s.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("_s"))
    return g.select("sample_id", F.array_join(F.transform("_s", lambda x: x["sentence"]), " ")
                    .alias("generated_description"))


def references(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(sample_id, gt_idx, gt_text): one reference caption per reference line."""
    s = _sentences(spark, sf_dir, only).filter(F.col("side") == "gt")
    return s.select("sample_id", F.col("pos").alias("gt_idx"), F.col("sentence").alias("gt_text"))

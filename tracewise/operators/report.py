"""Distribution, weighting and evaluation reports as tables.

All are aggregates (partial combine before the shuffle).  Ranks for AUC
come from running sums over *distinct* scores (range-partitioned, see
``sequence.ordered_index``), never from a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ordered_index


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts and percentage per label."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.select(label, "n", (F.col("n") * 100.0 / total).alias("pct"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """total / count x (3 if share < 5 %, 2 if < 10 %, else 1)."""
    return weights_of_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)


def weights_of_counts(g: DataFrame, label: str) -> DataFrame:
    """``class_weights`` of classes that are counted already (label, n): a window over a handful of rows."""
    total = F.sum("n").over(Window.partitionBy())
    cnt = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("n"))
    mult = F.when(cnt < total * 0.05, 3.0).when(cnt < total * 0.10, 2.0).otherwise(1.0)
    return g.select(label, "n", (total / cnt * mult).alias("weight"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """n / (2 * positives)."""
    return df.agg((F.count(F.lit(1)) / (2.0 * F.sum(F.col(label).cast("double")))).alias("pos_weight"))


def score_summary(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean score and positive-label rate."""
    return df.agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("label_rate"),
                  F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, y: str = "y", p: str = "pred", classes: DataFrame | None = None) -> DataFrame:
    """Counts for every (true, predicted) pair of known classes.

    ``classes`` (one column ``cls``) completes the grid with zeros; it is the
    label set, a few rows, so the grid is classes x classes.
    """
    c = pred.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        classes = pred.select(F.col(y).alias("cls")).union(pred.select(F.col(p).alias("cls"))).distinct()
    grid = classes.select(F.col("cls").alias(y)).crossJoin(classes.select(F.col("cls").alias(p)))
    return grid.join(c, [y, p], "left").select(y, p, F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Per-class precision, recall, F1, support; zero division -> 0."""
    tp = pred.groupBy(F.col(y).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col(y) == F.col(p)).alias("tp"))
    pp = pred.groupBy(F.col(p).alias("cls")).agg(F.count(F.lit(1)).alias("pred_n"))
    j = tp.join(pp, "cls", "full").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("pred_n", F.lit(0)).alias("pred_n"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return j.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support")


def summary_metrics(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Accuracy and macro / weighted averages of precision, recall, F1."""
    m = class_metrics(pred, y, p)
    acc = pred.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))
    n = F.sum("support")
    agg = m.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))
    return acc.crossJoin(agg)


def summary_metrics_by(pred: DataFrame, group: str, y: str = "y", p: str = "pred") -> DataFrame:
    """Accuracy and macro / weighted averages for every value of ``group``.

    Every count comes from one confusion table (groups x classes x classes
    rows): a cell counts once for its true and once for its predicted class.
    """
    c = pred.groupBy(group, y, p).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(y) == F.col(p), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(F.array(F.struct(F.col(y).cast("int").alias("cls"), F.col("n").alias("support"), hit.alias("tp"), F.lit(0).cast("long").alias("pred_n")),
                              F.struct(F.col(p).cast("int").alias("cls"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                                       F.col("n").alias("pred_n"))))
    m = c.select(group, sides.alias("s")).groupBy(group, "s.cls").agg(*[F.sum(f"s.{k}").alias(k) for k in ("support", "tp", "pred_n")])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    m = m.withColumns({"precision": prec, "recall": rec}).withColumn("f1", f1)
    mean = lambda k: (F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(f"weighted_{k}")
    return m.groupBy(group).agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                                *[F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")],
                                *[mean(k) for k in ("precision", "recall", "f1")])


def auc_by_group(scored: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """Tie-aware ROC AUC per group via the Mann-Whitney rank sum.

    Rows (group, score, positive 0/1).  Scores are combined per distinct
    value first; each distinct value's average rank is (rows below) +
    (ties + 1) / 2, from running sums over the distinct values.
    AUC = (R+ - n+(n+ + 1)/2) / (n+ n-); null if a class is absent.
    """
    d = scored.groupBy(group, score).agg(
        F.sum(F.col(positive).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    r = ordered_index(d, group, [score], out="_i", sums=["_cnt"])
    avg_rank = F.col("_cnt_cum") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0
    g = r.groupBy(group).agg(F.sum(F.col("_pos") * avg_rank).alias("_rp"), F.sum("_pos").alias("_np"),
                             F.sum("_cnt").alias("_n"))
    npos, nneg = F.col("_np"), F.col("_n") - F.col("_np")
    auc = F.when((npos > 0) & (nneg > 0), (F.col("_rp") - npos * (npos + 1) / 2.0) / (npos * nneg))
    return g.select(group, auc.alias("auc"), npos.alias("n_pos"), nneg.alias("n_neg"))


def auc_one_vs_rest(probs: DataFrame, y: str = "y", cls: str = "cls", prob: str = "prob") -> DataFrame:
    """Per-class one-vs-rest AUC plus macro and support-weighted averages.

    ``probs`` is long form (id, y, cls, prob): one row per class score.
    """
    per = auc_by_group(probs.withColumn("_is", (F.col(y) == F.col(cls)).cast("int")), cls, prob, "_is")
    avg = per.agg(F.avg("auc").alias("macro_auc"),
                  (F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("weighted_auc"))
    return per, avg


def auc_one_vs_rest_by(probs: DataFrame, group: str, y: str = "y", cls: str = "cls", prob: str = "prob") -> DataFrame:
    """Macro and support-weighted one-vs-rest AUC for every value of ``group``."""
    d = probs.select(F.struct(F.col(group).alias("g"), F.col(cls).alias("c")).alias("_gc"), F.col(prob).alias("_p"),
                     (F.col(y) == F.col(cls)).cast("int").alias("_is"))
    per = auc_by_group(d, "_gc", "_p", "_is").filter(F.col("auc").isNotNull())
    return per.groupBy(F.col("_gc.g").alias(group)).agg(
        F.avg("auc").alias("macro_auc"), (F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("weighted_auc"))


def importance_groups(imp: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Sum and share of importance by group: 0-61, 62-73, other."""
    idx = F.regexp_extract(F.col(feature), r"^feature_(\d+)", 1)
    num = F.when(idx != "", idx.cast("int"))
    grp = (F.when(num < 62, "signal_0_61").when((num >= 62) & (num <= 73), "signal_62_73")
            .otherwise("chunk_and_other"))
    g = imp.groupBy(grp.alias("group")).agg(F.sum(importance).alias("importance"))
    total = F.sum("importance").over(Window.partitionBy())
    return g.select("group", "importance",
                    F.coalesce(F.try_divide(F.col("importance") * 100.0, total), F.lit(0.0)).alias("share_pct"))


def feature_group_name(idx) -> F.Column:
    """Names of features 62-73."""
    return (F.when((idx >= 62) & (idx <= 63), "Layer Consistency")
             .when((idx >= 64) & (idx <= 65), "Attention Concentration")
             .when((idx >= 66) & (idx <= 70), "Perplexity/Confidence")
             .when((idx >= 71) & (idx <= 73), "Token Repetition/Novelty")
             .otherwise("Unknown"))


def top_importance(imp: DataFrame, k: int = 20, feature: str = "feature", importance: str = "importance"):
    """Importance ranking, top k overall (O4): a top-k report.

    ``orderBy().limit(k)`` plans as a per-partition top-k then a merge of
    k rows per task; the rank is numbered on those k rows only.
    """
    top = imp.orderBy(F.desc(importance), F.asc(feature)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(importance), F.asc(feature))))


def importance_report(imp: DataFrame, k: int = 20, k_signals: int = 10) -> DataFrame:
    """(section, rank, feature, group_name, importance, share_pct): the three parts of the importance report.

    ``top``: best ``k`` of all columns; ``signals_62_73``: best ``k_signals``
    of features 62 to 73 with their group names; ``groups``: totals and shares.
    """
    idx = F.when(F.regexp_extract("feature", r"^feature_(\d+)", 1) != "", F.regexp_extract("feature", r"^feature_(\d+)", 1).cast("int"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    top = top_importance(imp, k).select(F.lit("top").alias("section"), "rank", "feature", none("string", "group_name"), "importance",
                                        none("double", "share_pct"))
    late = top_importance(imp.filter(idx.between(62, 73)), k_signals).select(
        F.lit("signals_62_73").alias("section"), "rank", "feature", feature_group_name(idx).alias("group_name"), "importance",
        none("double", "share_pct"))
    groups = importance_groups(imp).select(F.lit("groups").alias("section"), none("int", "rank"), none("string", "feature"),
                                           F.col("group").alias("group_name"), "importance", "share_pct")
    return top.unionByName(late).unionByName(groups)


def run_summary(chunks: DataFrame, model_col: str, dataset_col: str, label: str) -> DataFrame:
    """One row per (model, dataset): totals and label mix."""
    return chunks.groupBy(model_col, dataset_col).agg(
        F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("sample_id").alias("total_samples"),
        F.avg((F.col(label) == "CORRECT").cast("double")).alias("correct_rate"))

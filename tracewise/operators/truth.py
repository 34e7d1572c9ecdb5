"""Ground-truth sources and joins onto feature rows.

Truth tables are keyed by file name / sample name and joined with plain
equi-joins; Spark picks broadcast or shuffle by measured size (AQE), so no
truth table is assumed small.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import join_aliases, split_aliases
from ..sources.files import CSV_OPTIONS, missing_columns, read_headers
from ..sources.json_arrays import RANGE_BYTES, read_json_arrays


_IMAGE = "id long, file_name string"
_ANNOTATION = "id long, image_id long, category_id long, caption string, bbox array<double>, area double, iscrowd int"
_CATEGORY = "id long, name string"


def coco_tables(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """COCO JSON -> (images, annotations, categories, annotation_type).

    The files are read once, by byte ranges.  Annotations keep their order
    (``path``, ``pos``) and their text (``json``).  The type is that of the first
    annotation: ``captions``, ``instances``, ``unknown``, or ``none`` without annotations.
    """
    rows = read_json_arrays(spark, path, range_bytes)

    def of(name, schema, *keep):
        return rows.filter(F.col("name") == name).select(F.from_json("json", schema).alias("r"), *keep).select(*keep, "r.*")

    ann = of("annotations", _ANNOTATION, "path", "offset", "json").withColumnRenamed("offset", "pos")
    first = rows.filter(F.col("name") == "annotations").agg(F.min_by("json", F.struct("path", "offset")).alias("j")).first()["j"]
    fields = set(json.loads(first)) if first else set()
    kind = "none" if first is None else "captions" if "caption" in fields else "instances" if "category_id" in fields else "unknown"
    return of("images", _IMAGE), ann, of("categories", _CATEGORY), kind


def reference_captions(spark: SparkSession, path: str, image_col: str = "image_filename", text_col: str = "generated_description") -> DataFrame:
    """Reference-caption CSV -> (image_filename, ground_truth), the last row of a file name wins.

    Raises ValueError naming the columns that the file lacks.
    """
    headers = read_headers(spark, path)
    for file, columns in headers:
        missing = missing_columns(columns, [image_col, text_col])
        if missing:
            raise ValueError(f"{file} lacks {', '.join(missing)}")
    rows = spark.read.options(**CSV_OPTIONS).csv(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    out = last_per_key(rows.filter(F.col(image_col).isNotNull()), image_col, text_col, ["_at"])
    return out.select(F.col(image_col).alias("image_filename"), F.coalesce(text_col, F.lit("")).alias("ground_truth"))


def annotations_by_file(images: DataFrame, ann: DataFrame) -> DataFrame:
    """Annotations inner-joined to images; unknown image ids drop."""
    return ann.join(images.withColumnRenamed("id", "image_id"), "image_id", "inner")


def with_category_names(ann: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join to categories; missing name -> ``category_{id}``."""
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_cn"))
    return ann.join(c, "category_id", "left").withColumn(
        "category", F.coalesce(F.col("_cn"), F.concat(F.lit("category_"), F.col("category_id").cast("string")))
    ).drop("_cn")


def captions_list(ann: DataFrame, order: list[str], key: str = "file_name") -> DataFrame:
    """Captions per file as a list in annotation order (A2).

    The list carries its order key, so the result does not depend on how
    rows were shuffled.
    """
    g = ann.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"),
                                                                  F.col("caption").alias("c")))).alias("_l"))
    return g.select(key, F.transform("_l", lambda x: x["c"]).alias("captions"))


def captions_wide(features: DataFrame, captions: DataFrame, key: str = "image_filename",
                  prefix: str = "ground_truth", counts: DataFrame | None = None) -> DataFrame:
    """``ground_truth_1..k`` columns, k = longest matched list, '' padding.

    k is one small aggregate job over the matched rows; the columns are then
    plain projections.  ``counts`` (file_name, n), if given, has the length of every list, so that no list is built for k.
    """
    j = features.join(captions.withColumnRenamed("file_name", key), key, "left")
    if counts is None:
        k = j.agg(F.max(F.size("captions"))).first()[0] or 0
    else:
        k = counts.withColumnRenamed("file_name", key).join(features.select(key), key, "left_semi").agg(F.max("n")).first()[0] or 0
    cols = [F.coalesce(F.try_element_at("captions", F.lit(i + 1)), F.lit("")).alias(f"{prefix}_{i + 1}")
            for i in range(max(k, 0))]
    return j.select(*[c for c in features.columns], *cols)


def category_summary(ann: DataFrame, order: list[str], key: str = "file_name") -> DataFrame:
    """``cat(n)`` if n > 1 else ``cat``, joined by ``", "`` in first-appearance order (A4)."""
    per = ann.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    s = F.when(F.col("n") > 1, F.concat("category", F.lit("("), F.col("n").cast("string"), F.lit(")"))
               ).otherwise(F.col("category"))
    per = per.select(key, "first", s.alias("s"))
    g = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "s"))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["s"]), ", ").alias("ground_truth"))


def instance_structs(ann: DataFrame, order: list[str], key: str = "file_name") -> DataFrame:
    """Instance annotations as an ordered list of structs and as JSON text (A5)."""
    st = F.struct(F.col("category"), F.col("category_id"), F.col("bbox"), F.col("area"))
    g = ann.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"),
                                                                  st.alias("v")))).alias("_l"))
    lst = F.transform("_l", lambda x: x["v"])
    return g.select(key, lst.alias("instances"), F.to_json(lst).alias("instances_json"))


def last_per_key(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Duplicate keys: the last row in ``order`` wins."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def left_join_truth(features: DataFrame, truth: DataFrame, key: str, cols: dict[str, Column]) -> DataFrame:
    """Left join; each truth column defaults to '' and a ``gt_matched`` flag is added."""
    t = truth.select(F.col(key), F.lit(True).alias("_m"), *[c.alias(n) for n, c in cols.items()])
    j = features.join(t, key, "left")
    out = [F.col(c) for c in features.columns]
    out += [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in cols]
    out.append(F.coalesce(F.col("_m"), F.lit(False)).alias("gt_matched"))
    return j.select(*out)


def match_report(joined: DataFrame) -> DataFrame:
    """Matched, total, unmatched and match rate in percent."""
    return joined.agg(
        F.count_if(F.col("gt_matched")).alias("matched"), F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("gt_matched")).alias("unmatched"),
        F.coalesce(F.try_divide(F.count_if(F.col("gt_matched")) * 100.0, F.count(F.lit(1))),
                   F.lit(0.0)).alias("match_rate"))


def answers_text(answers: Column, dtype: T.DataType) -> Column:
    """TyDiQA answers to text by type: struct -> JSON, array -> ``"; "`` join."""
    if isinstance(dtype, T.StructType):
        return F.to_json(answers)
    if isinstance(dtype, T.ArrayType):
        return join_aliases(answers.cast("array<string>"))
    return answers.cast("string")


def truth_list(dataset: str, df: DataFrame) -> Column:
    """Reference texts of a row as an array, by dataset.

    single column for mscoco/llava/truthfulqa/tydiqa; trivia = value then the
    ``;``-split aliases; otherwise every ``ground_truth_*`` column.  Null and
    '' entries are removed.
    """
    cols = df.columns

    def nz(c):
        return F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c).cast("string"))

    if dataset in ("mscoco", "llava", "truthfulqa", "tydiqa") and "ground_truth" in cols:
        arr = F.array(nz("ground_truth"))
    elif dataset == "triviaqa":
        val = F.array(nz("ground_truth_value")) if "ground_truth_value" in cols else F.array()
        al = split_aliases(F.col("ground_truth_aliases")) if "ground_truth_aliases" in cols else F.array()
        arr = F.concat(val, F.coalesce(al, F.array().cast("array<string>")))
    else:
        gcols = [c for c in cols if c.startswith("ground_truth_")]
        arr = F.array(*[nz(c) for c in gcols]) if gcols else F.array().cast("array<string>")
    return F.array_compact(arr)


def positional_merge(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Equi-join on a row key, plus the rows unmatched on either side."""
    joined = left.join(right, key, "inner")
    unmatched = left.select(key, F.lit("left").alias("side")).join(right.select(key), key, "left_anti").unionByName(
        right.select(key, F.lit("right").alias("side")).join(left.select(key), key, "left_anti"))
    return joined, unmatched

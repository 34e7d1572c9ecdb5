"""File sources and sinks.

Feature CSVs use the common dialect: quotes doubled inside quoted fields,
which may hold commas and newlines.  Folder scans read all headers in one
job and plan one scan per distinct header, not per file.
"""

from __future__ import annotations

import csv
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import model_name_from_file
from ..functions.text import sanitize_lines
from ..operators.features import to_csv_row
from ..session import materialize

# --- fixed values: columns a feature file must have, per dataset (P10) -------
REQUIRED_TRUTH = {
    "mscoco": ["ground_truth_1"],
    "llava": ["ground_truth"],
    "truthfulqa": ["ground_truth"],
    "triviaqa": ["ground_truth_aliases", "ground_truth_value"],
    "tydiqa": ["ground_truth"],
}
# ------------------------------------------------------------------------------


#: One option set for reading and writing feature CSVs.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_WRITE = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}


def read_headers(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[tuple[str, list[str]]]:
    """(path, column names) of each file: the first line of the split that starts at byte 0."""
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("h"))
    return sorted((r["file_path"], next(csv.reader([r["h"]]))) for r in first.collect())  # one row per file


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """File paths directly in ``folder`` with ``suffix`` (file metadata only)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
          .option("pathGlobFilter", f"*{suffix}").load(folder).select("path"))
    return sorted(r.path for r in df.collect())


def missing_columns(columns: list[str], required: list[str]) -> list[str]:
    """Required columns that are absent (U5, schema level)."""
    return [c for c in required if c not in set(columns)]


def load_feature_folder(spark: SparkSession, folder: str, dataset: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """All qualifying feature CSVs of a folder as one table, plus a status table.

    Each file's model name comes from its file name.  Files missing the
    dataset's truth columns are skipped and listed in the status table.
    The union is by name with missing columns as null; every column is text.
    """
    required = REQUIRED_TRUTH.get(dataset, [])
    groups: dict[tuple[str, ...], list[str]] = {}
    status = []
    for path, cols in read_headers(spark, folder):
        miss = missing_columns(cols, required)
        status.append((path, not miss, ",".join(miss)))
        if not miss:
            groups.setdefault(tuple(cols), []).append(path)
    st = spark.createDataFrame(status, "path string, loaded boolean, missing string")
    if not groups:
        return spark.createDataFrame([], "model_name string"), st
    out = None
    for cols, paths in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(paths)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    fname = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return out.withColumn("model_name", model_name_from_file(fname, prefix)), st


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """One feature CSV."""
    return spark.read.options(**CSV_OPTIONS).csv(path)


def write_feature_csv(df: DataFrame, path: str, mode: str = "append", max_rows: int = 0) -> None:
    """Feature rows as CSV with a header; list features as JSON text (S12).  A partition of more than ``max_rows`` rows goes on in further files."""
    to_csv_row(df).write.mode(mode).options(**_WRITE, maxRecordsPerFile=max_rows).csv(path)


def write_feature_bundle(df: DataFrame, path: str, metadata: dict) -> None:
    """Features as Parquet plus a one-row metadata JSON."""
    df.write.mode("overwrite").parquet(f"{path}/features")
    meta = dict(metadata)
    meta.setdefault("extraction_timestamp", datetime.now(timezone.utc).isoformat())
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/metadata")


def write_truth_joined(df: DataFrame, path: str) -> None:
    """Truth-joined rows of many input files, one folder per source file."""
    df.write.mode("overwrite").partitionBy("source_file").parquet(path)


def enrich_folder(spark: SparkSession, folder: str, truth: DataFrame, key: str, truth_cols: dict[str, Column], out: str) -> DataFrame:
    """Join every feature CSV of a folder with ``truth`` and write it; a row per file says how it went.

    A file whose header lacks ``key`` or names a column twice, or that holds a row with
    more or fewer fields than its header, is listed with its error and not
    written; the other files go on.  The rows of a good file go to its own folder under ``out``.
    Returns source_file, n_rows, matched and error (null if written).
    """
    from ..operators.truth import left_join_truth
    headers = read_headers(spark, folder)
    name = lambda p: p.rsplit("/", 1)[-1]
    status = []
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, columns in headers:
        if key not in columns:
            status.append((name(path), None, None, f"no column {key}"))
        elif len({c.lower() for c in columns}) < len(columns):
            status.append((name(path), None, None, "a column is named twice"))
        else:
            groups.setdefault(tuple(columns), []).append(path)
    bad, counts = "_corrupt_record", None
    for columns, paths in groups.items():  # a scan per distinct header
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, bad]])
        rows = (spark.read.options(**CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=bad).schema(schema).csv(paths)
                .withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))
        rows = materialize(rows)
        verdict = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), F.count(bad).alias("n_bad"))
        good = rows.join(verdict.filter("n_bad = 0").select("source_file"), "source_file", "left_semi").drop(bad)
        joined = materialize(left_join_truth(good, truth, key, truth_cols))
        joined.write.mode("append").partitionBy("source_file").parquet(out)
        matched = joined.groupBy("source_file").agg(F.count_if("gt_matched").alias("matched"))
        part = verdict.join(matched, "source_file", "left").select(
            "source_file", "n_rows", F.when(F.col("n_bad") == 0, F.coalesce("matched", F.lit(0))).alias("matched"),
            F.when(F.col("n_bad") > 0, F.concat(F.col("n_bad").cast("string"), F.lit(" damaged rows"))).alias("error"))
        counts = part if counts is None else counts.unionByName(part)
    listed = spark.createDataFrame(status, "source_file string, n_rows long, matched long, error string")
    return listed if counts is None else counts.unionByName(listed)


def write_chunk_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Chunk dataset sink."""
    w = df.write.mode("overwrite")
    (w.options(**_WRITE).csv(path) if fmt == "csv" else w.parquet(path))


def write_files(rows: DataFrame, path: str) -> None:
    """One file per row (name, content as binary) in folder ``path``, written by the tasks.  A name written again is replaced."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        fs, folder = pafs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with fs.open_output_stream(f"{folder}/{name}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
    rows.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def append_results(spark: SparkSession, row: dict, path: str) -> DataFrame:
    """Append one result row and read the log back with schema union."""
    df = spark.createDataFrame([row])
    df.write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def append_result_rows(rows: DataFrame, path: str, run_id: str | None = None) -> DataFrame:
    """Append result rows of any columns and read the whole log with schema union.

    With ``run_id`` the rows replace those of the same run, so a repeated write adds none twice.
    """
    if run_id is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    return rows.sparkSession.read.option("mergeSchema", True).parquet(path)


def write_text_column(df: DataFrame, col: str, path: str, strip_ends: bool = False) -> None:
    """One line per row, newlines replaced by spaces."""
    df.select(sanitize_lines(F.col(col).cast("string"), strip_ends).alias("value")).write.mode("overwrite").text(path)


def save_model(model, metrics: DataFrame, path: str, scaler: DataFrame | None = None, labels: DataFrame | None = None,
               features: list[str] | None = None) -> None:
    """Model artefact: the model, its metrics, and what scoring new rows needs.

    ``scaler``: the one-row table of ``prep.fit_scaler``; ``labels``: label names and indexes; ``features``: columns in model order.
    """
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    if scaler is not None:
        scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels")
    if features is not None:
        rows = metrics.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str):
    """(model, scaler, labels, features) of an artefact written with all its parts."""
    from pyspark.ml import PipelineModel
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    features = [r["feature"] for r in read("features").orderBy("i").collect()]  # a row per column
    return PipelineModel.load(f"{path}/model"), read("scaler"), read("labels"), features


def run_timestamp() -> F.Column:
    """ISO timestamp text of the run."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

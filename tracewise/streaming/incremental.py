"""Incremental jobs on Structured Streaming.

X1: finished samples arrive as files of ``(sample_id, p_max ARRAY<DOUBLE>,
p_min ARRAY<DOUBLE>, ...)``; per-row feature expressions need no state, so
the query runs in append mode into a file sink with a checkpoint (exactly
once per file).

X2: new feature files land in a folder; each micro-batch is joined with a
truth table loaded once (stream-static join) and written partitioned by
source file, so a failing file does not block the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import traces
from ..sources.files import CSV_OPTIONS


def trace_feature_stream(spark: SparkSession, src: str, schema: StructType, prob_col: str = "p_max",
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of per-sample trace features."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.parquet(src)
    feats = traces.row_features(F.col(prob_col).cast("array<double>"))
    return s.select("sample_id", *[v.alias(k) for k, v in feats.items()])


def start_trace_features(spark: SparkSession, src: str, schema: StructType, out: str, checkpoint: str,
                         available_now: bool = True):
    """Append the features of each new sample file to ``out`` (parquet)."""
    q = (trace_feature_stream(spark, src, schema).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def start_truth_enrichment(spark: SparkSession, src: str, schema: StructType, truth: DataFrame, key: str,
                           out: str, checkpoint: str, truth_cols: dict | None = None,
                           available_now: bool = True, max_files_per_trigger: int | None = None):
    """Join each batch of new feature rows with ``truth`` and write it under its batch number.

    A batch that is run again after a failure replaces its own folder
    (``batch=<number>``), so no row is written twice.  ``truth`` is read once when the query starts; Spark plans the join per
    batch (broadcast when it is small, by measured size).
    """
    from ..operators.truth import left_join_truth
    cols = truth_cols or {c: F.col(c) for c in truth.columns if c != key}
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = (reader.csv(src)
              .withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))

    def write(batch: DataFrame, epoch: int):
        j = left_join_truth(batch, truth, key, cols)
        j.write.mode("overwrite").partitionBy("source_file").parquet(f"{out}/batch={epoch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()

"""Token ids as ORC files (operator 10).

Files hold one row per document in ascending id order, with the ids as an
integer list: ORC packs it with its integer run-length encoding, keeps
minimum, maximum and row indexes per row group, and a Bloom filter on the
document id.  A reader can take any stripe alone and skips stripes and row
groups by metadata when it looks for some documents.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.session import ensure_checkpoint_dir

from .codecs import codec
from .common import narrow, record_batch, text_slices, texts_of

_FILE = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()),
                   ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_FILE_DDL = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000",
               "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.02"}


def _encoder(path: str, end_id: int | None):
    def run(batches):
        c, shard, start = codec(path), TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], dtype=np.int32)
        for batch in text_slices(batches, 4 << 20):
            ids = [np.concatenate([c.encode(t), end]) for t in texts_of(batch)]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), shard, dtype=np.int32)), batch.column("doc_id"),
                pa.array(start + offsets[:-1]), pa.array(n),
                pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(ids)))], schema=_FILE)
            start += int(offsets[-1])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write ids to ORC files in ascending id order.

    Null texts are empty; null ids come first; equal ids are ordered by text
    hash and rows equal in both keep one place each.  The range partitioning
    carries a row number as last key, so not even one repeated row can fill
    a task.  An empty table writes no rows.
    """
    d = narrow(docs, id_col, text_col).withColumn("_h", F.xxhash64("text")).withColumn("_n", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_n")]
    (d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(_encoder(tokenizer, end_id), _FILE_DDL)
     .write.options(**ORC_OPTIONS).orc(path))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``doc_ids`` is pushed to the files' indexes and Bloom filters.

    ``start`` counts the ids of all documents before: the place within the
    file plus the totals of the files before, which take one row per file.
    """
    rows = spark.read.schema(_FILE_DDL).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        off, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(off, off[1:])]
        yield record_batch(_DIGEST, {"doc_id": batch.column("doc_id"), "start": batch.column("start"),
                                     "n_tokens": batch.column("n_tokens"), "ids_crc32": crc})


def token_file_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write the files into the shared checkpoint folder, read them back and digest them."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return token_file_digest(read_token_files(spark, path))

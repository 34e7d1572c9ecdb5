"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors and, as Parquet, lets each
    later branch read only the columns it needs.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator uses, so others can neither clash nor be read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


ROW_KEY = "__row_key"


def row_key(id_col: str, text_col: str) -> Column:
    """Never null; equal for rows that repeat both id and text."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat_ws("|", part(F.col(id_col)), part(F.octet_length(F.col(text_col))), part(F.xxhash64(F.col(text_col)))).alias(ROW_KEY)


def text_slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches whose text column holds about ``most_bytes``
    (one longer text stands alone), which bounds a task's memory."""
    for batch in batches:
        sizes = [n or 0 for n in pa.compute.binary_length(batch.column(text_col)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[str]:
    """The texts of a batch; null reads as the empty text."""
    return [t or "" for t in batch.column(text_col).to_pylist()]


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


BITS_EACH = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def repeat_bitmap(counts: DataFrame) -> bytes:
    """Bitmap of the hashes ``h`` whose counts ``n`` sum to more than one."""
    return hash_bitmap(stored(counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "repeated"))


def hash_bitmap(hashes: DataFrame) -> bytes:
    """Bitmap of the hashes ``h`` of a stored table.

    It has ``BITS_EACH`` bits or more a hash (a power of two), at most
    ``MOST_BITS`` (64 MB).  Two hashes may share a bit, so a set bit means
    "perhaps listed", a clear one "surely not": up to MOST_BITS / BITS_EACH
    hashes at most an eighth of all others meets a set bit, beyond that more,
    which the join after it sorts out.
    """
    bits = min(max(1 << (BITS_EACH * hashes.count() - 1).bit_length(), LEAST_BITS), MOST_BITS)
    place = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p"))
    rows = (place.groupBy(F.floor(F.col("p") / 32768).alias("k"))
            .agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("bits")).toLocalIterator())  # 4 KB each, bits / 32768 at most
    out = bytearray(bits // 8)
    for r in rows:
        out[r["k"] * 4096:(r["k"] + 1) * 4096] = r["bits"]
    return bytes(out)


def bitmap_has(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    p = h & (len(bitmap) * 8 - 1)
    return (np.frombuffer(bitmap, dtype=np.uint8)[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)

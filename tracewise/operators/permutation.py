"""Permutation importance over a packed matrix (M12, O6): every row, every column, one job.

Test rows are ordered by id and kept in blocks.  A column's values are ordered by ``md5(id:column:seed)``, and the value
at rank i goes to the row at rank i.  Only a value and eight bytes of its hash travel to be ordered, and the
value alone to its row, a column of a block at a time; a row's margins are worked out once and a permuted
column changes them by its coefficients times the change of the value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import Block, Matrix, _get, _put

BLOCK_ROWS = 4096
GROUP_ROWS = 1 << 20  # about so many values are ordered by a task at once


def _ordered(m: Matrix) -> DataFrame:
    """(part, block, n, data): the rows of ``m`` in the order of their ids, in blocks."""
    order = m.order

    def run(b: Block):
        x = np.ascontiguousarray(b.dense()[order].T)
        yield [b.row_ids(), b.y.astype(np.int32), [r.tobytes() for r in x]]
    rows = m.rows(run, pa.schema([("row_id", pa.string()), ("y", pa.int32()), ("x", pa.binary())]), "row_id string, y int, x binary")
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def packed(batches):
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                x = np.stack([np.frombuffer(r.as_buffer(), np.float64) for r in some.column("x")], axis=1)
                data = _put({"ids": [i.encode() for i in some.column("row_id").to_pylist()], "y": some.column("y").to_numpy(), "x": np.ascontiguousarray(x)})
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), pa.array([some.num_rows]), pa.array([data], pa.binary())], schema=schema)
                block += 1
    return materialize(rows.repartitionByRange("row_id").sortWithinPartitions("row_id").mapInArrow(packed, "part long, block long, n long, data binary"))


def importance(m: Matrix, margins: Callable, coefficients: np.ndarray, seed: int = 42, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(j, hits, n): how many rows are judged right with column j permuted; j = -1: with no column permuted.

    ``margins`` (columns by rows -> classes by rows) and ``coefficients`` (classes by columns) are those of a linear model.
    """
    rows = _ordered(m)
    places = sorted((r.part, r.block, r.n) for r in rows.select("part", "block", "n").collect())  # a row per 4096 rows
    starts = np.concatenate([[0], np.cumsum([n for *_, n in places])]).astype(np.int64)
    number = {(p, b): i for i, (p, b, _) in enumerate(places)}
    total, dims = int(starts[-1]), len(m.columns)
    buckets = 1
    while total / buckets > group_rows:
        buckets *= 2
    shift, spark = 64 - (buckets - 1).bit_length(), rows.sparkSession

    def hashed(batches):
        for batch in batches:
            for part, block, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "data"))):
                b, found = _get(data), []
                start = int(starts[number[part, block]])
                for j in range(dims):
                    end = f":{j}:{seed}".encode()
                    h = np.frombuffer(b"".join([hashlib.md5(i + end).digest() for i in b["ids"]]), ">u8")[::2].astype(np.uint64)
                    bucket = (h >> np.uint64(shift)).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
                    for k in np.unique(bucket):
                        at = bucket == k
                        found.append((j, int(k), start, h[at].tobytes(), b["x"][j][at].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["j", "bucket", "start", "h", "v"])

    def sorted_values(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")  # equal hashes keep the order of the ids
        h, v = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("h", np.uint64), ("v", np.float64)))
        return pd.DataFrame({"j": [pdf["j"].iloc[0]], "bucket": [pdf["bucket"].iloc[0]], "n": [len(v)], "v": [v[np.argsort(h, kind="stable")].tobytes()]})

    cells = rows.mapInArrow(hashed, "j long, bucket long, start long, h binary, v binary")
    ranked = cells.groupBy("j", "bucket").applyInPandas(sorted_values, "j long, bucket long, n long, v binary")
    first = {}
    if buckets > 1:
        ranked = materialize(ranked)
        at = {}
        for r in ranked.select("j", "bucket", "n").sort("j", "bucket").collect():  # a row per column and million rows
            first[r.j, r.bucket] = at.get(r.j, 0)
            at[r.j] = first[r.j, r.bucket] + r.n

    def dealt(batches):
        """Runs of a column's ordered values to the blocks whose rows have those ranks."""
        for batch in batches:
            for j, bucket, v in zip(*(batch.column(c).to_pylist() for c in ("j", "bucket", "v"))):
                v, lo = np.frombuffer(v, np.float64), first.get((j, bucket), 0)
                which = np.arange(np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, lo + len(v), side="left"))
                cuts = np.maximum(starts[which], lo)
                ends = np.minimum(starts[which + 1], lo + len(v))
                made = [(int(i), j, int(a - starts[i]), v[a - lo:b - lo].tobytes()) for i, a, b in zip(which, cuts, ends) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["place", "j", "at", "v"])

    def scored(key, mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        b = _get(mine["data"].iloc[0])
        x, y = b["x"], b["y"]
        z, cols = margins(x), np.arange(len(y))
        out = [(-1, int((z.argmax(axis=0) == y).sum()), len(y))]
        for j, some in given.groupby("j"):
            v = np.empty(len(y))
            for at, part in zip(some["at"], some["v"]):
                part = np.frombuffer(part, np.float64)
                v[at:at + len(part)] = part
            out.append((j, int(((z + coefficients[:, j, None] * (v - x[j])).argmax(axis=0) == y[cols]).sum()), len(y)))
        return pd.DataFrame(out, columns=["j", "hits", "n"])

    values = ranked.mapInArrow(dealt, "place long, j long, at long, v binary")
    numbers = spark.createDataFrame([(p, b, i) for (p, b), i in number.items()], "part long, block long, place long")
    held = rows.join(F.broadcast(numbers), ["part", "block"]).select("place", "data")
    found = held.groupBy("place").cogroup(values.groupBy("place")).applyInPandas(scored, "j long, hits long, n long")
    return found.groupBy("j").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))

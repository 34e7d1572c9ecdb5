"""A chunk matrix in packed blocks: the columns of a sample once per sample, those of a chunk per chunk.

A row of the matrix is its sample's columns and its own.  A block holds many samples: their
distinct sample columns, and per chunk its own columns and its class.  What is summed over rows is
summed per chunk for a chunk's columns and per sample for the others, so that no
sample's columns are copied per chunk.  Blocks are compressed, without loss.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_ROWS = 4096  # about so many chunks in a block, which a processor's cache holds
_FRAME = pa.schema([("is_test", pa.bool_()), ("counts", pa.list_(pa.int64())), ("block", pa.binary())])
_FRAME_DDL = "is_test boolean, counts array<long>, block binary"


def _put(values: dict) -> bytes:
    raw = pickle.dumps(values, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def _get(block: bytes) -> dict:
    return pickle.loads(pa.decompress(memoryview(block)[8:], int.from_bytes(block[:8], "little"), codec="lz4", asbytes=True))


@dataclass
class Block:
    """``shared``: distinct sample columns (rows by columns); ``own``: chunk columns (columns by rows); ``n``: chunks of each sample."""
    ids: list
    group: list
    of: np.ndarray  # the row of ``shared`` of each sample
    n: np.ndarray
    shared: np.ndarray
    own: np.ndarray
    y: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.n) - self.n

    def spread(self, per_shared: np.ndarray) -> np.ndarray:
        """Columns by shared rows -> columns by chunks."""
        return np.repeat(per_shared[:, self.of], self.n, axis=1)

    def gathered(self, per_chunk: np.ndarray) -> np.ndarray:
        """Sums of columns by chunks -> columns by shared rows."""
        each = np.add.reduceat(per_chunk, self.starts, axis=1)
        return np.stack([np.bincount(self.of, r, len(self.shared)) for r in each])

    def dense(self) -> np.ndarray:
        """All columns by chunks, the sample's first."""
        return np.concatenate([self.spread(self.shared.T), self.own])

    @staticmethod
    def read(raw: pa.Scalar) -> "Block":
        return Block(**_get(raw.as_buffer()))

    def of_samples(self, mine: np.ndarray) -> "Block":
        """The block of some of its samples."""
        if len(mine) == len(self.n):
            return self
        n = self.n[mine]
        rows = np.repeat(self.starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        kept, of = np.unique(self.of[mine], return_inverse=True)
        return Block([self.ids[i] for i in mine], [self.group[i] for i in mine], of, n, self.shared[kept], self.own[:, rows], self.y[rows])

    def row_ids(self) -> list[str]:
        """``concat_ws('_', sample, chunk)``."""
        return [str(k) if i is None else f"{i}_{k}" for i, n in zip(self.ids, self.n.tolist()) for k in range(n)]


def _packed(classes: tuple, own: tuple):
    def run(batches):
        for batch in batches:
            chunks = batch.column("chunks")
            n = pa.compute.fill_null(pa.compute.list_value_length(chunks), 0).to_numpy().astype(np.int64)
            test = batch.column("is_test").to_numpy(zero_copy_only=False).astype(bool)
            every = chunks.flatten()
            y = every.field("label")
            y = pa.compute.index_in(y.cast(pa.string()), pa.array(classes, pa.string())).to_numpy(zero_copy_only=False).astype(np.int8)
            columns = np.stack([every.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in own]) if len(every) else np.zeros((len(own), 0))
            given = batch.column("shared")
            shared = given.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            ids, group = batch.column("id").to_pylist(), batch.column("group").to_pylist()
            starts, made = np.cumsum(n) - n, []
            for side in (False, True):
                at = np.flatnonzero((test == side) & (n > 0))
                for mine in np.split(at, np.flatnonzero(np.diff(np.cumsum(n[at]) // BLOCK_ROWS)) + 1):
                    if not len(mine):
                        continue
                    rows = np.repeat(starts[mine] - np.cumsum(n[mine]) + n[mine], n[mine]) + np.arange(n[mine].sum())
                    codes = {}
                    of = np.array([codes.setdefault(r.tobytes(), len(codes)) for r in shared[mine]], np.int64)
                    distinct = np.frombuffer(b"".join(codes), np.float64).reshape(len(codes), -1)
                    made.append((side, np.bincount(y[rows], minlength=len(classes)).tolist(), _put(
                        {"ids": [ids[i] for i in mine], "group": [group[i] for i in mine], "of": of, "n": n[mine], "shared": distinct, "own": np.ascontiguousarray(columns[:, rows]), "y": y[rows]})))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _FRAME)], schema=_FRAME)
    return run


def _scaled(shared_stats, own_stats):
    def run(batches):
        for batch in batches:
            blocks = []
            for raw in batch.column("block"):
                b = _get(raw.as_buffer())
                blocks.append(_put(b | {"shared": (b["shared"] - shared_stats[0]) / shared_stats[1], "own": (b["own"] - own_stats[0][:, None]) / own_stats[1][:, None]}))
            yield pa.RecordBatch.from_arrays([batch.column("is_test"), batch.column("counts"), pa.array(blocks, pa.binary())], schema=_FRAME)
    return run


def _mapped(fn: Callable, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for raw in batch.column("block"):
                for columns in fn(Block.read(raw)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _summed(fn: Callable, combine: Callable):
    def run(batches):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            for raw in batch.column("block"):
                s = fn(Block.read(raw))
                total = s if total is None else combine(total, s)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])
    return run


@dataclass(frozen=True)
class Matrix:
    """Rows of a chunk matrix with their class; ``frame`` has a row per block."""
    frame: DataFrame
    classes: tuple  # the class of each code; alphabetical
    shared: tuple  # names of the sample's columns
    own: tuple  # names of the chunk's columns
    columns: tuple  # all names in matrix order
    weights: np.ndarray | None = None  # a weight per class

    def side(self, test: bool) -> "Matrix":
        return replace(self, frame=self.frame.filter(F.col("is_test") == test))

    @functools.cached_property
    def counts(self) -> np.ndarray:
        """Rows of each class."""
        r = self.frame.agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(len(self.classes))]).first()
        return np.array(list(r), np.int64)

    @property
    def order(self) -> np.ndarray:
        """Places of the matrix's columns among the sample's and then the chunk's."""
        place = {c: i for i, c in enumerate([*self.shared, *self.own])}
        return np.array([place[c] for c in self.columns])

    def total(self, fn: Callable, combine: Callable = np.add) -> np.ndarray:
        """``fn`` (block -> numbers) combined over all blocks: a few numbers from each task, in the order of the tasks."""
        rows = self.frame.select("block").mapInArrow(_summed(fn, combine), "part long, sums binary").collect()
        return functools.reduce(combine, [np.frombuffer(r["sums"], np.float64) for r in sorted(rows, key=lambda r: r["part"])])

    def rows(self, fn: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
        """What ``fn`` (block -> lists of column values) gives for every block."""
        return self.frame.select("block").mapInArrow(_mapped(fn, schema), ddl)

    def size(self, name: str) -> DataFrame:
        """One row: how many rows there are."""
        return self.frame.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias(name))

    def groups(self) -> DataFrame:
        """(g, y, n): rows by group and class; an absent group is ''."""
        k = len(self.classes)

        def run(b: Block):
            names, code = np.unique(np.array([g or "" for g in b.group], dtype=object), return_inverse=True)
            n = np.bincount(np.repeat(code, b.n) * k + b.y, minlength=len(names) * k)
            yield [np.repeat(names, k), np.tile(np.arange(k, dtype=np.int32), len(names)), n.astype(np.int64)]
        schema = pa.schema([("g", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
        return self.rows(run, schema, "g string, y int, n long").groupBy("g", "y").agg(F.sum("n").alias("n"))

    def table(self) -> DataFrame:
        """A row per chunk: row_id, model_name, label, label_idx, weight and the columns."""
        order, weights = self.order, np.ones(len(self.classes)) if self.weights is None else self.weights

        classes = self.classes

        def run(b: Block):
            x = np.ascontiguousarray(b.dense()[order].T)
            yield [b.row_ids(), np.repeat(np.array(b.group, object), b.n), [classes[i] for i in b.y], b.y.astype(np.int32), weights[b.y],
                   pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())]
        names = ["row_id", "model_name", "label", "label_idx", "weight"]
        schema = pa.schema([*zip([*names, "x"], [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64())])])
        return self.rows(run, schema, "row_id string, model_name string, label string, label_idx int, weight double, x array<double>").select(
            *names, *[F.col("x")[i].alias(c) for i, c in enumerate(self.columns)])

    def known(self) -> "Matrix":
        """With classes that have rows alone, numbered anew, as a label encoder does (M1)."""
        kept = tuple(c for c, n in zip(self.classes, self.counts) if n)
        if kept == self.classes:
            return self
        to = np.array([kept.index(c) if c in kept else -1 for c in self.classes], np.int8)

        def run(batches):
            for batch in batches:
                blocks = []
                for raw in batch.column("block"):
                    b = _get(raw.as_buffer())
                    blocks.append(_put(b | {"y": to[b["y"]]}))
                counts = [[n for n, t in zip(c, to) if t >= 0] for c in batch.column("counts").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("is_test"), pa.array(counts, pa.list_(pa.int64())), pa.array(blocks, pa.binary())], schema=_FRAME)
        return replace(self, frame=materialize(self.frame.mapInArrow(run, _FRAME_DDL)), classes=kept)

    def scaler(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of the sample's and then the chunk's columns; a column of one value has deviation 0 and that mean."""
        def first(b: Block) -> np.ndarray:
            n = np.bincount(b.of, b.n, len(b.shared))
            sums = np.concatenate([n @ b.shared, b.own.sum(axis=1)])
            low = np.concatenate([b.shared.min(axis=0), b.own.min(axis=1)])
            high = np.concatenate([b.shared.max(axis=0), b.own.max(axis=1)])
            return np.stack([sums, np.full(len(sums), float(b.n.sum())), low, high])

        def merged(a, b):
            a, b = a.reshape(4, -1), b.reshape(4, -1)
            return np.stack([a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])])

        sums, n, low, high = self.total(first, merged).reshape(4, -1)
        mean = np.where(low == high, low, sums / n)
        k = len(self.shared)

        def second(b: Block) -> np.ndarray:
            return np.concatenate([np.bincount(b.of, b.n, len(b.shared)) @ (b.shared - mean[:k]) ** 2, ((b.own - mean[k:, None]) ** 2).sum(axis=1)])

        return mean, np.sqrt(self.total(second) / n)

    def scaled(self, stats: tuple[np.ndarray, np.ndarray]) -> "Matrix":
        """(x - mean) / deviation, deviation 0 -> 1."""
        mean, sd = stats
        sd, k = np.where(sd == 0, 1.0, sd), len(self.shared)
        return replace(self, frame=materialize(self.frame.mapInArrow(_scaled((mean[:k], sd[:k]), (mean[k:], sd[k:])), _FRAME_DDL)))


def pack(samples: DataFrame, classes: tuple, shared: tuple, own: tuple, columns: tuple) -> Matrix:
    """Blocks of ``samples``: id, group, is_test, shared (array of doubles), chunks (array of structs with ``label`` and ``own``)."""
    d = samples.select(F.col("id").cast("string").alias("id"), F.col("group").cast("string").alias("group"), "is_test", "shared", "chunks")
    return Matrix(materialize(d.mapInArrow(_packed(tuple(classes), tuple(own)), _FRAME_DDL)), tuple(classes), tuple(shared), tuple(own), tuple(columns))

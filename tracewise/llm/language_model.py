"""Hashed maximum-entropy language model (operator 5).

P(token | two tokens before) = P(class | context) * P(token | class, context).

* The commonest tokens fall into classes by frequency; all others form one
  last class.
* Context ids: the commonest tokens have their own, other tokens share hashed
  ids by their last two bytes.
* The numbers of words, classes, contexts and hashed features follow the number
  of training tokens (``model_shape``).
* Class scores add four feature families: bias, previous token (n-gram), the
  one before it (skip), and both, hashed.  Token scores inside a class add
  bias and previous token.  Both are softmaxes.
* Inside the last class, a token has its discounted training frequency, and
  the discounted mass is the unknown token's.  That is what is left of the
  previous token's mass after the discounted counts of the pairs (previous
  token, token) that training has ``LEAST_PAIR`` times or more, which are
  added.  These pairs name both tokens, and their number grows with the corpus.

The counts behind the softmax features are gathered over all training
documents; each update sums the gradients of their shards.  Scoring is table
look-ups over whole batches of tokens.  Counts and contexts of common tokens
travel in a bounded table, those of the rest and all pairs are joined; a
bitmap keeps most unseen pairs out of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_has, hash_bitmap, id_remainder, narrow, record_batch, stored, text_slices, texts_of

HEAD_TOKENS = 1 << 18
SUFFIXES = 64
LEAST_PAIR = 2
EPOCHS = 12
TRAIN_TASKS = 8


@dataclass(frozen=True)
class Shape:
    """Sizes of the softmax model."""

    words: int  # tokens with a class of their own
    class_words: int
    contexts: int  # context ids of one position
    hashed: int  # rows of hashed features of context pairs

    @property
    def classes(self) -> int:
        return -(-self.words // self.class_words) + 1

    @property
    def class_cells(self) -> int:
        return self.contexts * self.contexts * self.classes

    @property
    def cells(self) -> int:
        return self.class_cells + self.contexts * self.words


def model_shape(total: int, head: int) -> Shape:
    """Sizes from the number of training tokens, among them at most ``head`` words.

    Words grow with the cube root of the tokens and contexts with their
    logarithm: 10^8 tokens give 1184 words in 36 classes and 281 contexts,
    10^13 give 43,344 words in 210 classes and 409 contexts, whose tables of
    logarithms take 0.21 GB.  A class has about as many words as there are
    classes; 16 pairs of contexts share a hashed feature.
    """
    words = min(head, 256 + 2 * round(total ** (1 / 3)))
    contexts = 1 + SUFFIXES + 8 * round(math.log2(total + 1))
    return Shape(words, max(1, math.isqrt(words)), contexts, contexts * contexts // 16)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)  # a fixed random number per byte
_FACTOR = np.uint64(0xD1342543DE82EF95)
_POWERS = np.ones(1, dtype=np.uint64)
# byte map: A-Z to lower case, the six ASCII spaces to one
_FOLD = bytes(32 if c in b"\t\n\x0b\x0c\r " else c for c in bytes(range(256)).lower())


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256), _FACTOR)]), dtype=np.uint64)
    return _POWERS


def token_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each token from the tokens' bytes in a row: a polynomial in random byte numbers, mixed with the length."""
    start = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(start, size)
    h = np.add.reduceat(_BYTE[data] * _powers(int(size.max()))[place], start) if len(size) else np.zeros(0, np.uint64)
    return _mixed(h + size.astype(np.uint64) * _GOLDEN)


END = int(_mixed(np.zeros(1, np.uint64))[0])


def hashed_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts (each closed by the end token), suffix codes, and tokens per text.  No token becomes an object."""
    raw = [t.encode() for t in texts]
    line = np.frombuffer(b" ".join(raw).translate(_FOLD), dtype=np.uint8)
    inside = line != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    of_text = np.searchsorted(ends, start, side="right")
    sizes = np.bincount(of_text, minlength=len(texts)).astype(np.int64) + 1
    at = np.arange(len(start)) + of_text  # an end token stands after each text before
    h = np.full(len(start) + len(texts), END, dtype=np.uint64)
    h[at] = token_hashes(line[inside], stop - start)
    suffix = np.full(len(h), (32 * 31 + 32) % SUFFIXES, dtype=np.int64)
    second = np.where(stop - start > 1, line[np.maximum(stop - 2, 0)], 32) if len(start) else np.zeros(0, np.int64)
    suffix[at] = (line[stop - 1].astype(np.int64) * 31 + second) % SUFFIXES if len(start) else 0
    return h, suffix, sizes


def _slices(batches):
    return text_slices(batches, 1 << 20)  # what a slice needs stays in the cache


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of every token of all ``docs``; a token is named by its 64-bit hash as a signed integer."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def put(held):
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for batch in _slices(batches):
            keys, n = np.unique(hashed_tokens(texts_of(batch))[0], return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > 3_000_000:
                keys, n = put(held)
                yield record_batch(schema, {"h": keys.view(np.int64), "n": n})
                held, size = [], 0
        if held:
            keys, n = put(held)
            for i in range(0, len(keys), 500_000):
                yield record_batch(schema, {"h": keys[i:i + 500_000].view(np.int64), "n": n[i:i + 500_000]})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Tables:
    """What every scoring task holds; sizes follow HEAD_TOKENS and ``model_shape``."""

    hashes: np.ndarray  # head tokens' hashes, ascending
    counts: np.ndarray  # their training counts
    rank: np.ndarray  # their rank by count
    shape: Shape
    total: int
    distinct: int
    rest_total: int
    rest_distinct: int
    discount: float
    class_log: np.ndarray | None = None  # (contexts * contexts, classes) log10 P(class | context)
    word_log: np.ndarray | None = None  # (contexts, words) log10 P(token | class, previous)
    left_log: np.ndarray | None = None  # by rank: log10 of the mass a previous token leaves to the frequencies
    pair_bits: bytes | None = None  # bitmap of the pairs' keys

    def by_rank(self) -> np.ndarray:
        """Hashes of the head tokens, commonest first."""
        out = np.empty_like(self.hashes)
        out[self.rank] = self.hashes
        return out

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each token in the head, -1 outside."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, self.rank[k], -1)

    def contexts(self, rank: np.ndarray, suffix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Context pair number of each token: (token before the last) * contexts + last; 0 before the start."""
        own = self.shape.contexts - SUFFIXES - 1
        ids = np.where((rank >= 0) & (rank < own), 1 + SUFFIXES + rank, 1 + suffix)
        last, skip = np.zeros_like(ids), np.zeros_like(ids)
        last[1:], skip[2:] = ids[:-1], ids[:-2]
        starts = np.cumsum(sizes) - sizes
        last[starts] = 0
        skip[starts] = 0
        second = starts[sizes > 1] + 1
        skip[second] = 0
        return skip * self.shape.contexts + last


def head_tables(counts: DataFrame) -> Tables:
    """Sizes of the training counts and the commonest tokens, at most HEAD_TOKENS.

    The least count of a head token comes from a histogram of counts cut to
    eight significant bits, so no sort of the vocabulary is needed.
    """
    bits = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
    cut = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 8, 0)), greatest(length(bin(n)) - 8, 0))")
    levels = (counts.groupBy(F.when(bits > 0, cut).otherwise(F.col("n")).alias("level"))
              .agg(F.count("*").alias("k"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect())
    by_level = {r["level"]: r["k"] for r in levels}
    least, held = None, 0
    for r in levels:
        if held + r["k"] > HEAD_TOKENS:
            break
        least, held = r["level"], held + r["k"]
    rows = counts.filter(F.col("n") >= least).collect() if least is not None else []
    h, n = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.lexsort((h, -n))
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.arange(len(h))
    up = np.argsort(h)
    total, distinct = sum(r["n"] for r in levels), sum(r["k"] for r in levels)
    shape = model_shape(total, len(h))
    once, twice = by_level.get(1, 0), by_level.get(2, 0)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return Tables(h[up], n[up], rank[up], shape, total, distinct, total - int(n[order[:shape.words]].sum()), distinct - shape.words, discount)


def previous(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the end token before a text's first."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(sizes) - sizes] = END
    return out


def pair_key(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    return ((u << np.uint64(1) | u >> np.uint64(63)) ^ h).view(np.int64)


CELL, COMMON_PAIR, RARE_PAIR, TOTAL = 0, 1, 2, 3
_HELD_PAIRS = 4_000_000


def training_counts(docs: DataFrame, tables) -> DataFrame:
    """(kind, k, h, n) of all ``docs``, in one pass over the texts.

    CELL: counts of (context pair, class), then of (previous token, word), k the cell's number.
    Pairs (previous token, token of the last class) from LEAST_PAIR on:
    COMMON_PAIR, both head tokens, has both ranks in k; RARE_PAIR has the
    tokens in k and h.  TOTAL: how often k stands before any token of the last class.
    """
    schema = pa.schema([("kind", pa.int8()), ("k", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def rows(kind, k, n, h=None):
        for i in range(0, len(k), 500_000):
            part = slice(i, i + 500_000)
            size = len(k[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), pa.array(k[part].view(np.int64)),
                                              pa.nulls(size, pa.int64()) if h is None else pa.array(h[part].view(np.int64)), pa.array(n[part])], schema=schema)

    def run(batches):
        t = tables.value
        shape = t.shape
        cells, totals = np.zeros(shape.cells, dtype=np.int64), np.zeros(max(len(t.hashes), 1), dtype=np.int64)
        held, length = [], 0
        for batch in _slices(batches):
            h, suffix, sizes = hashed_tokens(texts_of(batch))
            rank = t.ranks(h)
            pair = t.contexts(rank, suffix, sizes)
            known = (rank >= 0) & (rank < shape.words)
            cell = np.concatenate([pair * shape.classes + np.where(known, rank // shape.class_words, shape.classes - 1),
                                   shape.class_cells + pair[known] % shape.contexts * shape.words + rank[known]])
            cell, n = np.unique(cell, return_counts=True)
            cells[cell] += n
            starts = np.cumsum(sizes) - sizes
            before = np.empty_like(rank)
            before[1:] = rank[:-1]
            before[starts] = t.ranks(np.array([END], dtype=np.uint64))[0]
            rest = ~known
            u, h, before, rank = previous(h, sizes)[rest], h[rest], before[rest], rank[rest]
            totals += np.bincount(before[before >= 0], minlength=len(totals))
            common = (before >= 0) & (rank >= 0)
            held.append(before[common] << 32 | rank[common])
            length += len(held[-1])
            if length > _HELD_PAIRS:
                yield from rows(COMMON_PAIR, *np.unique(np.concatenate(held), return_counts=True))
                held, length = [], 0
            far, n = np.unique(u[before < 0], return_counts=True)
            yield from rows(TOTAL, far, n)
            u, h = u[~common], h[~common]
            _, at, n = np.unique(pair_key(u, h), return_index=True, return_counts=True)
            yield from rows(RARE_PAIR, u[at], n, h[at])
        if held:
            yield from rows(COMMON_PAIR, *np.unique(np.concatenate(held), return_counts=True))
        seen = np.flatnonzero(cells)
        yield from rows(CELL, seen, cells[seen])
        seen = np.flatnonzero(totals)
        if len(seen):
            yield from rows(TOTAL, t.by_rank()[seen], totals[seen])

    counted = docs.select("text").mapInArrow(run, "kind byte, k long, h long, n long").groupBy("kind", "k", "h").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("kind").isin(CELL, TOTAL) | (F.col("n") >= LEAST_PAIR))


def repeated_pairs(counted: DataFrame, tables) -> DataFrame:
    """(u, h, n) of the pairs of ``training_counts``, both tokens by their hashes."""
    schema = pa.schema([("u", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def unpack(batches):
        token = tables.value.by_rank().view(np.int64)
        for batch in batches:
            k = batch.column("k").to_numpy()
            yield record_batch(schema, {"u": token[k >> 32], "h": token[k & 0xFFFFFFFF], "n": batch.column("n")})

    common = counted.filter(F.col("kind") == COMMON_PAIR).select("k", "n").mapInArrow(unpack, "u long, h long, n long")
    return common.unionByName(counted.filter(F.col("kind") == RARE_PAIR).select(F.col("k").alias("u"), "h", "n"))


def rest_model(seen: DataFrame, total: DataFrame, counts: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What a previous token u does to the frequencies of the last class.

    (u, total, left): the share of u's mass that its pairs leave, for each u
    with a pair; (p, gain): log10 of a pair's probability over that share of
    its frequency, by the pair's key.
    """
    taken = F.col("n") - F.lit(tables.discount)
    contexts = stored(seen.groupBy("u").agg(F.sum(taken).alias("taken")).join(total, "u")
                      .select("u", "total", (1 - F.col("taken") / F.col("total")).alias("left")), "contexts")
    frequency = counts.select("h", ((F.col("n") - F.lit(tables.discount)) / max(tables.rest_total, 1)).alias("frequency"))
    key = F.shiftleft("u", 1).bitwiseOR(F.shiftrightunsigned("u", 63)).bitwiseXOR(F.col("h")).alias("p")
    gain = F.log10(1 + taken / (F.col("total") * F.col("left") * F.col("frequency"))).alias("gain")
    return contexts, stored(seen.join(contexts, "u").join(frequency, "h").select(key, gain), "gains")


def _pair_rows(pairs: np.ndarray, hashed: int) -> np.ndarray:
    """Hashed feature row of a context pair."""
    return (pairs * 1103515245 + 12345) % 2147483647 % hashed


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Weights:
    """Feature weights as one flat vector with named views."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape = shape
        sizes = {"bias": (1, shape.classes), "last": (shape.contexts, shape.classes), "skip": (shape.contexts, shape.classes),
                 "pair": (shape.hashed, shape.classes), "word_bias": (1, shape.words), "word_last": (shape.contexts, shape.words)}
        ends = np.cumsum([a * b for a, b in sizes.values()])
        self.flat = np.zeros(int(ends[-1])) if flat is None else flat
        for (name, size), end in zip(sizes.items(), ends):
            setattr(self, name, self.flat[end - size[0] * size[1]:end].reshape(size))

    def class_log(self, pairs: np.ndarray) -> np.ndarray:
        n = self.shape.contexts
        return _log_softmax(self.bias + self.last[pairs % n] + self.skip[pairs // n] + self.pair[_pair_rows(pairs, self.shape.hashed)])

    def word_log(self, last: np.ndarray) -> np.ndarray:
        x, many = self.word_bias + self.word_last[last], self.shape.class_words
        return np.concatenate([_log_softmax(x[:, i:i + many]) for i in range(0, x.shape[1], many)], axis=1) if x.shape[1] else x


def _feature_sums(shape: Shape, cells: np.ndarray, n: np.ndarray, w: Weights | None = None) -> np.ndarray:
    """Counts of all features over whole contexts: as observed, or as the weights expect them."""
    out = Weights(shape)
    c, k = cells[cells < shape.class_cells], n[cells < shape.class_cells]
    if len(c):
        pairs, row = np.unique(c // shape.classes, return_inverse=True)
        x = np.zeros((len(pairs), shape.classes))
        x[row, c % shape.classes] = k
        if w is not None:
            x = x.sum(axis=1, keepdims=True) * np.exp(w.class_log(pairs))
        out.bias += x.sum(axis=0)
        np.add.at(out.last, pairs % shape.contexts, x)
        np.add.at(out.skip, pairs // shape.contexts, x)
        np.add.at(out.pair, _pair_rows(pairs, shape.hashed), x)
    c, k = cells[cells >= shape.class_cells] - shape.class_cells, n[cells >= shape.class_cells]
    if len(c):
        last, row = np.unique(c // shape.words, return_inverse=True)
        x = np.zeros((len(last), shape.words))
        x[row, c % shape.words] = k
        if w is not None:
            log = w.word_log(last)
            for i in range(0, shape.words, shape.class_words):
                part = slice(i, i + shape.class_words)
                x[:, part] = x[:, part].sum(axis=1, keepdims=True) * np.exp(log[:, part])
        out.word_bias += x.sum(axis=0)
        out.word_last[last] += x
    return out.flat


def train(cells: DataFrame, tables: Tables, epochs: int = EPOCHS) -> Weights:
    """Full-batch gradient updates; each epoch is one job over the shards of the counts.

    A step divides the gradient (observed less expected count of a feature)
    by the mean of both plus a constant and by the features that share it.
    Contexts of one hashed feature are in one shard, so only the features of
    single tokens come from several shards; the driver holds one number per
    feature, as the weights do.
    """
    shape = tables.shape
    row = F.expr(f"cell div {shape.classes}") * 1103515245 + 12345
    shard = F.when(F.col("cell") < shape.class_cells, row % 2147483647 % shape.hashed).otherwise(
        F.expr(f"(cell - {shape.class_cells}) div {max(shape.words, 1)}"))
    shards = cells.repartition(TRAIN_TASKS, shard).persist(StorageLevel.MEMORY_AND_DISK)  # lost parts come again from the stored counts
    schema = pa.schema([("i", pa.int32()), ("n", pa.float64())])

    def summed(flat: np.ndarray | None) -> np.ndarray:
        sent = cells.sparkSession.sparkContext.broadcast(flat)

        def run(batches):
            rows = list(batches)  # a shard of the bounded cells
            if rows:
                cell, n = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("cell", "n"))
                x = _feature_sums(shape, cell, n, None if sent.value is None else Weights(shape, sent.value))
                i = np.flatnonzero(x)
                yield record_batch(schema, {"i": i.astype(np.int32), "n": x[i]})

        parts = shards.mapInArrow(run, "i int, n double").toArrow()
        sent.destroy()
        return np.bincount(parts.column("i").to_numpy(), weights=parts.column("n").to_numpy(), minlength=Weights(shape).flat.size)

    w = Weights(shape)
    words = w.word_bias.size + w.word_last.size
    share = np.repeat([4.0, 2.0], [w.flat.size - words, words])
    seen = summed(None)
    for _ in range(epochs):
        want = summed(w.flat)
        w = Weights(shape, w.flat + 2 * (seen - want) / ((seen + want) / 2 + 1.0) / share)
    shards.unpersist()
    return w


def score(docs: DataFrame, counts: DataFrame, contexts: DataFrame, gains: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()),
                        ("base", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.int64())),
                        ("far", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64()))])

    def lists(values, chosen, starts):
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(chosen, starts, dtype=np.int64))])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(values[chosen].view(np.int64)))

    def run(batches):
        t: Tables = sent.value
        by_rank = t.counts[np.argsort(t.rank)] if len(t.rank) else t.counts
        base_log = np.log10(by_rank + 1.0)
        rest_log = np.log10(np.maximum(by_rank - t.discount, 1e-9) / max(t.rest_total, 1))
        key = TaskContext.get().partitionId() << 33
        for batch in _slices(batches):
            h, suffix, sizes = hashed_tokens(texts_of(batch))
            rank = t.ranks(h)
            pair = t.contexts(rank, suffix, sizes)
            head, word = rank >= 0, (rank >= 0) & (rank < t.shape.words)
            base = np.zeros(len(h))
            base[head] = base_log[rank[head]]
            model = t.class_log[pair, np.where(word, rank // t.shape.class_words, t.shape.classes - 1)].astype(np.float64)
            model[word] += t.word_log[pair[word] % t.shape.contexts, rank[word]]
            other = head & ~word
            model[other] += rest_log[rank[other]]
            starts, u = np.cumsum(sizes) - sizes, previous(h, sizes)
            before, keys = t.ranks(u), pair_key(u, h)
            model += np.where(word | (before < 0), 0.0, t.left_log[before] if len(t.left_log) else 0.0)
            tails = np.add.reduceat(~head, starts)
            yield pa.RecordBatch.from_arrays([
                pa.array(key + np.arange(len(sizes))), batch.column("doc_id"), pa.array(sizes), pa.array(sizes - tails),
                pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts)),
                lists(h, ~head, starts), lists(u, ~word & (before < 0), starts), lists(keys, ~word & bitmap_has(t.pair_bits, keys), starts)],
                schema=schema)
            key += len(sizes)

    ddl = "row_key long, doc_id long, n_tokens long, n_head long, base double, model double, tail array<long>, far array<long>, pairs array<long>"
    rows = stored(narrow(docs, id_col, text_col).mapInArrow(run, ddl), "scores")
    least = int(tables.counts.min()) if len(tables.counts) else 0
    rare = counts.filter(F.col("n") < least) if least else counts
    tail = rows.select("row_key", F.explode("tail").alias("h")).join(rare, "h")
    sums = tail.groupBy("row_key").agg(F.count("*").alias("m"), F.sum(F.log10(F.col("n") + 1.0)).alias("b"),
                                       F.sum(F.log10((F.col("n") - F.lit(tables.discount)) / max(tables.rest_total, 1))).alias("p"))
    far = rows.select("row_key", F.explode("far").alias("u")).join(contexts, "u").groupBy("row_key").agg(F.sum(F.log10("left")).alias("f"))
    known = rows.select("row_key", F.explode("pairs").alias("p")).join(gains, "p").groupBy("row_key").agg(F.sum("gain").alias("g"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unknown = math.log10(tables.discount * tables.rest_distinct / tables.rest_total) if tables.rest_total else 0.0
    per_token = math.log10(tables.total + tables.distinct + 1)
    rows = rows.drop("tail", "far", "pairs").join(sums, "row_key", "left").join(far, "row_key", "left").join(known, "row_key", "left")
    return rows.select(
        "doc_id", "n_tokens", (F.col("n_head") + zero("m")).alias("n_known"),
        (F.col("base") + zero("b") - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + zero("p") + zero("f") + zero("g") + (F.col("n_tokens") - F.col("n_head") - zero("m")) * unknown).alias("score"))


def language_model(docs: DataFrame, training: DataFrame) -> tuple[DataFrame, Tables]:
    """Scores of all ``docs`` by a model of ``training`` (columns doc_id, text), and the model.

    Null texts are empty and have the end token alone; repeated rows count and
    score each.  Without training tokens every base probability is 1 and the
    model knows one class.
    """
    counts = stored(token_counts(narrow(training, "doc_id", "text")), "counts")
    tables = head_tables(counts)
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    counted = stored(training_counts(narrow(training, "doc_id", "text"), sent), "training-counts")
    w = train(counted.filter(F.col("kind") == CELL).select(F.col("k").alias("cell"), "n"), tables)
    n, log10 = tables.shape.contexts, 1 / math.log(10)
    tables.class_log = np.concatenate([(w.class_log(np.arange(i, i + n)) * log10).astype(np.float32) for i in range(0, n * n, n)])
    tables.word_log = (w.word_log(np.arange(n)) * log10).astype(np.float32)
    total = counted.filter(F.col("kind") == TOTAL).select(F.col("k").alias("u"), F.col("n").alias("total"))
    contexts, gains = rest_model(repeated_pairs(counted, sent), total, counts, tables)
    tables.left_log = np.zeros(len(tables.rank))
    if len(tables.counts):
        common = counts.filter(F.col("n") >= int(tables.counts.min())).select(F.col("h").alias("u"))
        left = contexts.join(common, "u").select("u", "left").collect()  # of head tokens
        rank = tables.ranks(np.array([r["u"] for r in left], dtype=np.int64).view(np.uint64))
        tables.left_log[rank] = np.log10([r["left"] for r in left])
    tables.pair_bits = hash_bitmap(gains.select(F.col("p").alias("h")))
    return score(docs, counts, contexts, gains, tables), tables


def scored_documents(docs: DataFrame) -> DataFrame:
    """The whole table scored by a model of the documents whose id remainder by 7 is not 2."""
    held_out = id_remainder("doc_id", 7) == 2
    scores, tables = language_model(docs, docs.filter(~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         F.lit(tables.total).cast("long").alias("train_tokens"), "base_score", "score")

"""SimHash near-duplicates linked through BK-trees (operator 3).

Two fingerprints of 64 bits that differ in at most r of them agree on at
least one of r + 1 bit blocks, so every (block, value) is a shard, and close
pairs share a shard.  Each shard's distinct fingerprints form a BK-tree
(children keyed by integer Hamming distance to the parent), and a search
follows only the edges within the radius.  Shards travel by shuffle, not by
broadcast, since their size has no bound.  A shard of more tiles of ``TILE``
fingerprints than its finer shards would be is cut further: its members' other
bits in 2 r blocks agree on at least r of them, so every choice of r blocks
and their values is a finer shard.  What is still above a tile is split into
tile pairs, so no key fills a task.  A task returns a spanning set of its
links (each fingerprint to its tile's root), never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, narrow, record_batch, row_key, stored, text_slices, texts_of, unused
from .components import connected_components

SHINGLE = 3
RADIUS = 3
TILE = 1024
SEED = 42


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of one whole text, as a signed integer.

    A bit is set when over half of the shingles' hashes have it.
    """
    tokens = text.encode().lower().split()  # bytes: lower() maps A-Z alone, split() the six ASCII spaces
    if not tokens:
        return 0
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist())
    h = np.fromiter((digest(line[a:b], seed) for a, b in pairs), dtype=np.uint64, count=len(tokens) - k + 1)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        rows = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def bk_links(shard: np.ndarray, fps: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs (index of the asking fingerprint, index of the found one) of many shards' BK-trees.

    ``shard``: shard number (small integers) of each fingerprint.  ``asks``: which of them ask.
    The forest is built and searched level by level over arrays: a node's
    children are the groups of equal distance to it, a group's first member
    is the child node, and the search frontier keeps (asker, node) pairs whose
    edge differs from the measured distance by at most the radius.
    """
    n = len(fps)
    _, group = np.unique(shard, return_inverse=True)
    left = np.arange(n)
    parent, edge, roots = np.full(n, -1), np.full(n, -1), None
    while len(left):
        order = np.argsort(group, kind="stable")
        left, group = left[order], group[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        node = left[first][np.cumsum(first) - 1]
        if roots is None:
            roots = np.full(shard.max() + 1, -1)
            roots[shard[left[first]]] = left[first]
        rest = ~first
        left, node = left[rest], node[rest]
        d = np.bitwise_count(fps[left] ^ fps[node]).astype(np.int64)
        parent[left], edge[left] = node, d  # the last level that a node takes part in leaves its own parent
        _, group = np.unique(node * 65 + d, return_inverse=True)
    kids = np.flatnonzero(parent >= 0)
    key = parent[kids] * 65 + edge[kids]
    order = np.argsort(key, kind="stable")
    kids, key = kids[order], key[order]
    found_a, found_b = [], []
    step = max(1, (1 << 21) // np.bincount(shard).max())  # a frontier holds at most an asker's shard
    for i in range(0, len(asks), step):
        q = asks[i:i + step]
        node = roots[shard[q]]
        while len(q):
            d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            found_a.append(q[near])
            found_b.append(node[near])
            low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), side="left")
            high = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), side="right")
            many = high - low
            q = np.repeat(q, many)
            node = kids[np.repeat(low, many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)]
    return np.concatenate(found_a), np.concatenate(found_b)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked to each of n through the pairs (min-label rounds with pointer jumps)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _tile_links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for pdf in _runs(batches):
            shard = np.unique(pdf[["block", "value", "tile"]].to_numpy(), axis=0, return_inverse=True)[1].ravel()
            fps = pdf["fp"].to_numpy().astype(np.uint64)
            order = np.lexsort((fps, shard))
            shard, fps = shard[order], fps[order]
            a, b = bk_links(shard, fps, np.arange(len(fps)), radius)
            root = spanning(a, b, len(fps))
            own = np.flatnonzero(root != np.arange(len(fps)))
            yield record_batch(schema, {"a": fps[own].view(np.int64), "b": fps[root[own]].view(np.int64)})
    return run


def _runs(batches, most: int = 1 << 16):
    """Frames of whole tiles, about ``most`` rows each, from rows sorted by tile."""
    held = None
    keys = ["block", "value", "tile"]
    for batch in batches:
        pdf = batch.to_pandas()
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        held = pdf
        if len(pdf) < most:
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1)
        if not last.all():
            yield pdf[~last]
            held = pdf[last]
    if held is not None and len(held):
        yield held


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def shard_masks(radius: int) -> list[tuple[int, list[int]]]:
    """Bit masks of the shards, each with the wider masks of its finer shards.

    Two fingerprints at most ``radius`` bits apart agree under at least one
    mask, and under at least one of that mask's finer ones.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        rest = [b for b in range(64) if not low <= b < high]
        ends = [len(rest) * i // max(2 * radius, 1) for i in range(2 * radius + 1)]
        blocks = [sum(1 << b for b in rest[x:y]) for x, y in zip(ends, ends[1:])]
        own = sum(1 << b for b in range(low, high))
        out.append((own, [own | sum(c) for c in combinations(blocks, radius)]))
    return out


def shards_of(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(block, value, fp): the shards of every fingerprint, finer ones in place of large ones."""
    masks = shard_masks(radius)
    many = len(masks[0][1])

    def keys(chosen, first):
        return F.array(*[F.struct(F.lit(first + i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(chosen)])

    shards = fingerprints.select("fp", F.explode(keys([own for own, _ in masks], 0)).alias("k")).select("fp", "k.block", "k.value")
    large = (shards.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > many * TILE)
             .select("block", "value", F.lit(True).alias("large")))
    k = F.array(F.struct("block", "value"))
    for i, (_, finer) in enumerate(masks):
        k = F.when(F.col("large") & (F.col("block") == i), keys(finer, len(masks) + i * many)).otherwise(k)
    return shards.join(large, ["block", "value"], "left").select("fp", F.explode(k).alias("k")).select("k.block", "k.value", "fp")


def close_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column ``fp``) at most ``radius`` bits apart."""
    shards = shards_of(fingerprints, radius)
    sizes = shards.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    sized = shards.join(sizes, ["block", "value"]).select("block", "value", "fp", parts.alias("parts"),
                                                          F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    # part i meets part j in tile (min, max): every pair of a shard meets in one tile at least
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiled = (sized.select("block", "value", "fp", "parts", "part", other)
             .select("block", "value", "fp", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("tile")))
    return (tiled.repartition("block", "value", "tile").sortWithinPartitions("block", "value", "tile")
            .mapInArrow(_tile_links(radius), "a long, b long").distinct())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("fp", pa.int64())])

    def run(batches):
        for batch in text_slices(batches):
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "row_key": batch.column(ROW_KEY),
                                        "fp": [simhash(t, shingle, seed) for t in texts_of(batch)]})

    d = narrow(docs, id_col, text_col)
    return d.select("doc_id", "text", row_key("doc_id", "text")).mapInArrow(run, "doc_id long, row_key string, fp long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, fingerprint, component_id and group_fp of every row.

    ``component_id``: smallest id reachable over links of at most ``radius``
    bits, the row's own included; ``group_fp`` names the component by its
    smallest fingerprint.  Null or empty texts have fingerprint zero and link
    like any other.  Repeated rows stay rows of the same component; null ids
    are skipped by the minimum, and a component without ids has a null one.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = stored(close_links(distinct.select("fp"), radius), "links")
    groups = connected_components(links)
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group_fp", F.coalesce("component", "fp"))
    firsts = named.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    of_fp = named.select("fp", "group_fp").join(firsts, "group_fp")
    return rows.join(of_fp, "fp").select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_fp")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, less all but one of each near-duplicate group.

    The row with the smallest id stays (null ids last, then by text hash); of
    rows that repeat id and text, one stays.
    """
    near = near_duplicates(docs, shingle, radius, id_col, text_col)
    key = unused(docs, ROW_KEY)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("row_key").alias(key)))
    keys = near.groupBy("group_fp").agg(first.alias("k")).select(f"k.{key}")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(keys, key).dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Benchmark decontamination by a positional inverted index (operator 1).

The training text is indexed by document shard: each segment of the index
holds, for the terms that the test items use, sorted position lists of the
documents of one slice of a partition.  Segments are stored in the shared
checkpoint folder.  A query phrase starts from the positions of its rarest
term (by corpus counts read off the index) and intersects the offset-adjusted
lists of the next rarer ones, so it never leaves its segment: no posting is
shuffled, and a word in every document costs no task more than its own text.

Test items are taken in blocks of at most ``ITEM_BLOCK_BYTES`` of text; each
block's phrases are the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, record_batch, stored, text_slices, texts_of, unused

ITEM_BLOCK_BYTES = 8 << 20
WINDOW = 13
SLOP = 16
# byte map: A-Z to lower case; digits, a-z and the bytes of characters beyond ASCII as they are; the rest to spaces
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

_INDEX = pa.schema([("n_postings", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())),
                    ("bases", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())),
                    ("ends", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])
_INDEX_DDL = ("n_postings long, doc_ids array<long>, text_hashes array<long>, bases array<long>, n_words array<long>, "
              "terms array<int>, ends array<long>, positions array<int>")
_HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                   ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])
_HITS_DDL = "doc_id long, text_hash long, n_words long, hits array<array<long>>, items array<string>, near_items array<string>"


def words(text: str) -> list[bytes]:
    """Words (UTF-8) after lower-casing A-Z: runs of digits, letters a-z and characters beyond ASCII."""
    return text.encode().translate(_FOLD).split()


class Phrases:
    """The distinct windows of a block of test items, with their items, as arrays.

    Row i of ``terms`` holds the terms of phrase i, filled up with the number
    of terms (a term that every segment is said to have).
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int32)
            if not len(ids):
                continue
            if len(ids) < window:
                ids = np.concatenate([ids, np.full(window - len(ids), -1, np.int32)])
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window).copy())
            owners.append(np.full(len(rows[-1]), number[item_id]))
        every = np.concatenate(rows)
        _, at, phrase = np.unique(every.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.terms = every[at]
        self.terms[self.terms < 0] = len(self.vocabulary)
        pairs = np.unique(phrase.ravel() * max(len(self.names), 1) + np.concatenate(owners))
        self.item = pairs % max(len(self.names), 1)
        self.item_end = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(at)), side="right")
        self.offsets = self.by_rarest = self.first = None

    def items(self, i: int) -> list[str]:
        return [self.names[k] for k in self.item[self.item_end[i - 1] if i else 0:self.item_end[i]]]

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """Put each phrase's terms in order of ``counts`` (per term), rarest first, with their offsets; file phrases under their rarest."""
        n = len(self.vocabulary)
        count = np.append(counts, np.iinfo(np.int64).max)
        self.offsets = np.empty(self.terms.shape, np.int16)
        place = np.arange(self.terms.shape[1])
        for i in range(0, len(self.terms), 1 << 16):
            part = self.terms[i:i + (1 << 16)]
            order = np.lexsort((np.broadcast_to(place, part.shape), part, count[part]), axis=1)
            self.offsets[i:i + (1 << 16)] = order
            self.terms[i:i + (1 << 16)] = np.take_along_axis(part, order, axis=1)
        self.by_rarest = np.argsort(self.terms[:, 0], kind="stable")
        self.first = np.searchsorted(self.terms[self.by_rarest, 0], np.arange(n + 1))

    def plan(self, i: int) -> list[tuple[int, int]]:
        """Phrase i's (term, offset) pairs, rarest first."""
        return [(t, k) for t, k in zip(self.terms[i].tolist(), self.offsets[i].tolist()) if t < len(self.vocabulary)]

    def possible(self, present: np.ndarray) -> np.ndarray:
        """Phrases all of whose terms are in ``present`` (ascending); only those filed under one of them are looked at."""
        a, b = self.first[present], self.first[present + 1]
        size = b - a
        rows = self.by_rarest[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        has = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        has[present] = has[-1] = True
        parts = [rows[i:i + 65536][has[self.terms[rows[i:i + 65536]]].all(axis=1)] for i in range(0, len(rows), 65536)]
        return np.concatenate(parts) if parts else rows


def _build(vocabulary) -> object:
    def run(batches):
        ids_of = vocabulary.value.get
        for batch in text_slices(batches, 24 << 20):
            found, at, bases, sizes, base = [], [], [], [], 0
            for text in texts_of(batch):
                w = words(text)
                ids = np.fromiter(map(ids_of, w, repeat(-1)), dtype=np.int32, count=len(w))
                known = np.flatnonzero(ids >= 0)
                found.append(ids[known])
                at.append((known + base).astype(np.int32))
                bases.append(base)
                sizes.append(len(w))
                base += len(w) + 1  # the free place keeps phrases within one document
            ids, at = np.concatenate(found), np.concatenate(at)
            order = np.argsort(ids, kind="stable")  # positions stay ascending within a term
            terms, counts = np.unique(ids, return_counts=True)
            yield record_batch(_INDEX, {
                "n_postings": [len(ids)], "doc_ids": [batch.column("doc_id").to_pylist()],
                "text_hashes": [batch.column("text_hash").to_pylist()], "bases": [bases], "n_words": [sizes],
                "terms": [terms], "ends": [np.cumsum(counts)], "positions": [at[order]]})
    return run


def _near(lists: dict[int, np.ndarray], plan: list[tuple[int, int]], slop: int) -> np.ndarray:
    """Positions of the rarest term with every other term of the phrase within ``slop`` words."""
    at, seen = lists[plan[0][0]], {plan[0][0]}
    for term, _ in plan[1:]:
        if term not in seen and len(at):
            seen.add(term)
            other = lists[term]
            k = np.searchsorted(other, at - slop)
            at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= at + slop)]
    return at


def _phrase(lists: dict[int, np.ndarray], plan: list[tuple[int, int]]) -> np.ndarray:
    """Start positions of the exact phrase: offset-adjusted lists intersected, rarest first."""
    start = lists[plan[0][0]] - plan[0][1]
    for term, offset in plan[1:]:
        if not len(start):
            break
        other = lists[term]
        k = np.minimum(np.searchsorted(other, start + offset), len(other) - 1)
        start = start[other[k] == start + offset]
    return start


def _search(phrases, slop: int) -> object:
    def run(batches):
        p: Phrases = phrases.value
        for batch in batches:
            for row in range(batch.num_rows):
                part = {n: batch.column(n)[row].values for n in batch.schema.names if n != "n_postings"}
                terms, ends = part["terms"].to_numpy(), part["ends"].to_numpy()
                positions, bases = part["positions"].to_numpy().astype(np.int64), part["bases"].to_numpy()
                lists = {int(t): positions[a:b] for t, a, b in zip(terms, np.concatenate([[0], ends[:-1]]).astype(int), ends)}
                spans: dict[int, list] = {}
                exact: dict[int, set] = {}
                close: dict[int, set] = {}
                for i in p.possible(terms.astype(np.int64)).tolist():
                    plan, items = p.plan(i), p.items(i)
                    near = _near(lists, plan, slop)
                    if not len(near) and len(plan) <= slop + 1:
                        continue  # an exact match lies within the window, so it is near as well
                    doc = np.searchsorted(bases, near, side="right") - 1
                    for d in np.unique(doc).tolist():
                        close.setdefault(d, set()).update(items)
                    start = _phrase(lists, plan)
                    doc = np.searchsorted(bases, start, side="right") - 1
                    for d, s in zip(doc.tolist(), (start - bases[doc]).tolist()):
                        spans.setdefault(d, []).append([s, s + len(plan)])
                        exact.setdefault(d, set()).update(items)
                n = len(bases)
                yield record_batch(_HITS, {
                    "doc_id": part["doc_ids"], "text_hash": part["text_hashes"], "n_words": part["n_words"],
                    "hits": [_merged(spans.get(d, ())) for d in range(n)], "items": [sorted(exact.get(d, ())) for d in range(n)],
                    "near_items": [sorted(close.get(d, ())) for d in range(n)]})
    return run


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """Test items by hash block; each block's text is bounded, so may be held at once."""
    t = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    total = t.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + total // ITEM_BLOCK_BYTES
    for k in range(n):
        yield [(r["i"], r["t"]) for r in t.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id",
            text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Exact phrase and proximity matches: doc_id, text_hash, n_words, hits, items, near_items.

    ``hits``: merged [start, end) word spans inside any occurrence of a
    window; ``items``: ids of items with an occurring window; ``near_items``:
    ids of items with a window whose terms all lie within ``slop`` words of its
    rarest term.  Rows that repeat both id and text are one document; equal ids
    with other texts stay apart.  Null texts have no words, a null item id is
    the empty string, an item without words has no window.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    found = None
    for block in _blocks(items, item_id_col, item_text_col):
        phrases = Phrases(block, window)
        index = stored(d.mapInArrow(_build(spark.sparkContext.broadcast(phrases.vocabulary)), _INDEX_DDL), "postings")
        sizes = F.transform(F.sequence(F.lit(0), F.size("ends") - 1), lambda k: F.get("ends", k) - F.coalesce(F.get("ends", k - 1), F.lit(0)))
        counts = (index.filter("n_postings > 0").select(F.explode(F.arrays_zip("terms", sizes.alias("n"))).alias("x"))
                  .groupBy("x.terms").agg(F.sum("x.n").alias("n")).collect())  # at most the block's vocabulary
        count = np.zeros(len(phrases.vocabulary), np.int64)
        count[[r["terms"] for r in counts]] = [r["n"] for r in counts]
        phrases.order_by_rarity(count)
        hits = index.mapInArrow(_search(spark.sparkContext.broadcast(phrases), slop), _HITS_DDL)
        found = hits if found is None else found.unionByName(hits)
    flat = lambda c: F.flatten(F.collect_set(c))  # a set: rows that repeat id and text hold one entry per block
    return found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(flat("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(flat("items"))).alias("items"),
        F.array_sort(F.array_distinct(flat("near_items"))).alias("near_items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, share: float = 0.05, **columns) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``contaminated``: at least one word hit and hits of at least ``share`` of
    the words.  Spans of several blocks are united before they are counted.
    """
    m = matches(docs, items, window, slop, **columns)
    step = lambda a, h: F.struct(
        F.greatest(a["end"], h[1]).alias("end"), (a["n"] + F.greatest(h[1] - F.greatest(a["end"], h[0]), F.lit(0))).alias("n"))
    n_hit = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step)["n"]
    return (m.withColumn("n_hit", n_hit)
            .select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words"))).alias("contaminated"),
                    F.size("near_items").cast("long").alias("n_near")))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns as they are, less the contaminated ones."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **limits).filter("contaminated")
    i, h = unused(docs, "bad_id"), unused(docs, "bad_hash")
    bad = bad.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h))
    return docs.join(bad, same, "left_anti")

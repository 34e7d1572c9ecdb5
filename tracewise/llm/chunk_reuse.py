"""BPE encoding and decoding by content-defined chunk reuse (operator 8).

1. A rolling (gear) hash over the text proposes cuts, moved to the next white
   space; every chunk's hash is counted over all documents.
2. The hashes found more than once set bits of a fixed-size bitmap, the only
   thing broadcast (8 MB at any corpus size).  A false
   bit only sends one more chunk through step 4.
3. Documents without a shared chunk are encoded and digested in that same
   pass.  The others become segments: shared chunks, and the runs between.
4. Each distinct shared chunk is encoded once; its ids and the words at its
   ends are joined back by its 128-bit hash.  A document's segments are put
   together, and each join is repaired.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import Codec, codec
from .common import bitmap_has, narrow, record_batch, repeat_bitmap, stored, text_slices, texts_of

EDGE_WORDS = 8  # words kept at each end of an encoded run for the repair of joins
CHUNK_BITS = 10  # one cut in 2**10 bytes on average
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def chunk_cuts(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Byte offsets of chunk limits, 0 and the end included.

    The gear hash of the 32 bytes up to each place is the sum of their table
    values shifted by age, built for all places at once by doubling.  A cut
    stands before the first white space after a hit, so it depends on the
    bytes near it alone, and a text without white space is one chunk.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h[k:] += older
    hits = np.flatnonzero(h >> np.uint32(32 - bits) == 0)
    if not len(hits):
        return [0, len(b)]
    spaces = np.flatnonzero(_SPACE[b])
    at = np.searchsorted(spaces, hits, side="right")
    cuts = np.unique(spaces[at[at < len(spaces)]])
    return [0, *cuts[cuts > 0].tolist(), len(b)]


def _chunks(data: bytes, bits: int) -> list[bytes]:
    cuts = chunk_cuts(data, bits)
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _digest(chunk: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shared_bitmap(docs: DataFrame, bits: int = CHUNK_BITS) -> bytes:
    """Bitmap of the chunk hashes that occur more than once."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in text_slices(batches):
            h = [_digest(c)[0] for t in texts_of(batch) for c in _chunks(t.encode(), bits)]
            keys, n = np.unique(np.array(h, dtype=np.int64), return_counts=True)
            yield record_batch(schema, {"h": keys, "n": n})

    return repeat_bitmap(docs.mapInArrow(count, "h long, n long"))


def _outer_words(text: str, words: int, tail: bool) -> str:
    """The last (or first) ``words`` white-space separated words with the space before (or before and between), or all of it."""
    parts = text.rsplit(maxsplit=words) if tail else text.split(maxsplit=words)
    if len(parts) <= words:
        return text
    if tail:
        return text[len(parts[0]):]  # rsplit leaves the rest's leading space in place
    return text[:len(text) - len(parts[-1])].rstrip()


class Piece(NamedTuple):
    """Ids of a run of text with the words at its ends; ``whole``: both ends are all of it."""

    head: str
    tail: str
    whole: bool
    ids: np.ndarray


def piece(text: str, ids: np.ndarray) -> Piece:
    head = _outer_words(text, EDGE_WORDS, False)
    return Piece(head, _outer_words(text, EDGE_WORDS, True), head == text, ids)


def joined(c: Codec, left: Piece, right: Piece) -> Piece | np.ndarray | None:
    """Repair the join of two runs around their meeting ends.

    The words next to the join are re-encoded together.  That counts when the
    two sides' ids end and begin with what their outer words give alone, and
    the joint ids agree with these at the outer ends; otherwise more words are
    taken.  Returns the left side's final ids if nothing moved, else the
    joined piece, or None if the ends at hand do not lead to agreement.
    """
    words = 2
    while words <= EDGE_WORDS:
        tail, head = _outer_words(left.tail, words, True), _outer_words(right.head, words, False)
        joint, a, b = c.encode(tail + head), c.encode(tail), c.encode(head)
        keep = len(left.ids) - len(a)
        fits = keep >= 0 and np.array_equal(left.ids[keep:], a) and np.array_equal(right.ids[:len(b)], b)
        first, last = c.encode(_outer_words(tail, 1, False)), c.encode(_outer_words(head, 1, True))
        if fits and np.array_equal(joint[:len(first)], first) and np.array_equal(joint[len(joint) - len(last):], last):
            if np.array_equal(joint, np.concatenate([a, b])):
                return left.ids
            return _beside(left, right, np.concatenate([left.ids[:keep], joint, right.ids[len(b):]]))
        words *= 2
    if left.whole and right.whole:
        return _beside(left, right, c.encode(left.tail + right.head))
    return None


def _beside(left: Piece, right: Piece, ids: np.ndarray) -> Piece:
    return Piece(left.head + right.head if left.whole else left.head, left.tail + right.tail if right.whole else right.tail,
                 left.whole and right.whole, ids)


def assembled(c: Codec, pieces: list[Piece]) -> np.ndarray | None:
    """Ids of a whole text from its runs in order; None if a join needs more text than the runs' ends."""
    done, last = [], pieces[0]
    for p in pieces[1:]:
        both = joined(c, last, p)
        if both is None:
            return None
        if isinstance(both, Piece):
            last = both
        else:
            done.append(both)
            last = p
    return np.concatenate([*done, last.ids])


_ROW = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("seq", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
                  ("text", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("whole", pa.bool_()), ("ids", pa.binary()),
                  ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_ROW_DDL = ("row_key long, doc_id long, text_hash long, seq int, h1 long, h2 long, text string, head string, tail string, whole boolean, "
            "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
_RESULT = ["doc_id", "text_hash", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
_RESULT_DDL = "doc_id long, text_hash long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def _summary(c: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(c.decode(ids).encode()).hexdigest())


def _packed(c: Codec) -> type:
    return np.uint16 if c.vocab_size <= 1 << 16 else np.int32


def encode_decode(docs: DataFrame, tokenizer: str, bits: int = CHUNK_BITS, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids`` as 32-bit integers) of every row.

    Null texts are empty: no tokens, digests of nothing.  Repeated rows give a
    row each, null ids stay null, an empty table gives no rows.  No group is
    larger than one document, a chunk found in a third of all documents is
    one row of the encoded side of a join that splits skewed keys.  A document
    whose joins do not agree within EDGE_WORDS words is encoded as a whole.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast(shared_bitmap(d, bits))

    def cut(batches):
        c, flags = codec(tokenizer), shared.value
        packed, key = _packed(c), TaskContext.get().partitionId() << 33
        for batch in text_slices(batches, 4 << 20):
            cols = {f.name: [] for f in _ROW}

            def put(**values):
                for name, col in cols.items():
                    col.append(values.get(name))

            def put_run(own, seq, run):
                text = run.decode()
                ids = c.encode(text)
                p = piece(text, ids)
                put(**own, seq=seq, head=p.head, tail=p.tail, whole=p.whole, ids=ids.astype(packed).tobytes())

            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch)):
                parts, key = _chunks(text.encode(), bits), key + 1
                marks = [_digest(p) for p in parts]
                hot = bitmap_has(flags, np.array([h for h, _ in marks], dtype=np.int64)).tolist()
                own = {"row_key": key, "doc_id": doc_id, "text_hash": text_hash}
                if not any(hot):
                    ids = c.encode(text)
                    n, x, y = _summary(c, ids)
                    put(**own, seq=-1, ids=ids.tobytes() if with_ids else None, n_tokens=n, ids_sha256=x, decoded_sha256=y)
                    continue
                run, seq = b"", 0
                for p, mark, is_hot in zip(parts, marks, hot):
                    if not is_hot:
                        run += p
                        continue
                    if run:
                        put_run(own, seq, run)
                        run, seq = b"", seq + 1
                    put(**own, seq=seq, h1=mark[0], h2=mark[1], text=p.decode())
                    seq += 1
                if run:
                    put_run(own, seq, run)
            yield record_batch(_ROW, cols)

    def encode_once(batches):
        c = codec(tokenizer)
        packed, names = _packed(c), ["h1", "h2", "head", "tail", "whole", "ids"]
        for batch in text_slices(batches, 4 << 20):
            pieces = [piece(t, c.encode(t)) for t in texts_of(batch)]
            yield record_batch(pa.schema([_ROW.field(n) for n in names]), {
                "h1": batch.column("h1"), "h2": batch.column("h2"), "head": [p.head for p in pieces], "tail": [p.tail for p in pieces],
                "whole": [p.whole for p in pieces], "ids": [p.ids.astype(packed).tobytes() for p in pieces]})

    schema = pa.schema([_ROW.field(n) for n in _RESULT])

    def put_together(batches):
        c = codec(tokenizer)
        packed = _packed(c)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, cols = batch.slice(i, 64), {n: [] for n in _RESULT}
                for doc_id, text_hash, parts in zip(*[part.column(n).to_pylist() for n in ("doc_id", "text_hash", "parts")]):
                    ids = assembled(c, [Piece(s["head"], s["tail"], s["whole"], np.frombuffer(s["ids"], dtype=packed).astype(np.int32)) for s in parts])
                    known = (None, None, None) if ids is None else _summary(c, ids)
                    for name, v in zip(cols, (doc_id, text_hash, *known, ids.tobytes() if with_ids and ids is not None else None)):
                        cols[name].append(v)
                yield record_batch(schema, cols)

    def encode_whole(batches):
        c = codec(tokenizer)
        for batch in text_slices(batches, 4 << 20):
            ids = [c.encode(t) for t in texts_of(batch)]
            known = [_summary(c, x) for x in ids]
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                                        **{n: [k[j] for k in known] for j, n in enumerate(_RESULT[2:5])},
                                        "ids": [x.tobytes() if with_ids else None for x in ids]})

    rows = stored(d.mapInArrow(cut, _ROW_DDL), "segments")
    ends = ["row_key", "doc_id", "text_hash", "seq", "head", "tail", "whole", "ids"]
    reused = rows.filter("h1 is not null")
    once = (reused.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
            .mapInArrow(encode_once, "h1 long, h2 long, head string, tail string, whole boolean, ids binary"))
    known = reused.select("row_key", "doc_id", "text_hash", "seq", "h1", "h2").join(once, ["h1", "h2"]).select(ends)
    own = rows.filter("seq >= 0 and h1 is null").select(ends)
    put = stored(known.unionByName(own).groupBy("row_key", "doc_id", "text_hash")
                 .agg(F.sort_array(F.collect_list(F.struct("seq", "head", "tail", "whole", "ids"))).alias("parts"))
                 .select("doc_id", "text_hash", "parts").mapInArrow(put_together, _RESULT_DDL), "assembled")
    out = rows.filter("seq < 0").select(_RESULT).unionByName(put.filter("n_tokens is not null"))
    open_joins = put.filter("n_tokens is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    if not open_joins.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        out = out.unionByName(d.join(open_joins, same, "left_semi").mapInArrow(encode_whole, _RESULT_DDL))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)

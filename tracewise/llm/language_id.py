"""Language identification by hyperdimensional profiles (operator 4).

Each letter has a random vector of +1 and -1 drawn from its code point.  A
trigram binds its letters' vectors, permuted by place (rotated twice, once,
not at all), by multiplication; a text bundles its trigrams by addition; a
language's prototype bundles the unit vectors of its training texts.  The
predicted language has the largest cosine.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, narrow, record_batch, text_slices, texts_of

DIMENSIONS = 512
TRAIN_DOCS = 2000  # bound on training documents per language, drawn by hash
SEED = 20240229
UNKNOWN = "und"


@functools.lru_cache(maxsize=1 << 16)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[code, SEED])).integers(0, 2, dimensions, dtype=np.int8)
    return (bits * 2 - 1).astype(np.int8)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased letters with runs of anything else as one 0, and each one's text."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    present = np.flatnonzero(np.bincount(codes))
    letters = np.zeros(int(present[-1]) + 1, dtype=np.uint32)
    for c in present.tolist():
        if chr(c).isalpha():
            letters[c] = c
    symbols = letters[codes]
    keep = (symbols != 0) | np.concatenate([[False], symbols[:-1] != 0])
    return symbols[keep], owner[keep]


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bundled trigram vectors, one row per text; a row of zeros for a text without letters."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    symbols, owner = _symbols(texts)
    # a 0 before a text's first letter completes its first trigram
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(first)
    symbols, owner = np.insert(symbols, at, 0), np.insert(owner, at, owner[at])
    inside = owner[2:] == owner[:-2]
    if not inside.any():
        return out
    alphabet, local = np.unique(symbols, return_inverse=True)
    n = len(alphabet)
    gram = (local[:-2] * n + local[1:-1]) * n + local[2:]
    key, count = np.unique(owner[:-2][inside].astype(np.int64) * n ** 3 + gram[inside], return_counts=True)
    text, (grams, column) = key // n ** 3, np.unique(key % n ** 3, return_inverse=True)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    one, two = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    order = np.argsort(column, kind="stable")
    text, column, count = text[order], column[order], count[order]
    for i in range(0, len(grams), 4096):
        g = grams[i:i + 4096]
        bound = (two[g // (n * n)] * one[g // n % n] * vectors[g % n]).astype(np.float32)
        a, b = np.searchsorted(column, [i, i + len(g)])
        dense = np.zeros((len(texts), len(g)), dtype=np.float32)
        dense[text[a:b], column[a:b] - i] = count[a:b]
        out += dense @ bound
    return out


def _units(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _in_groups(batches, most_texts: int = 512, text_col: str = "text"):
    for batch in text_slices(batches, 2 << 20, text_col):
        for i in range(0, batch.num_rows, most_texts):
            yield batch.slice(i, most_texts)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          dimensions: int = DIMENSIONS, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Prototype of each language from its non-null labelled texts.

    At most about ``train_docs`` documents per language, drawn by a hash of
    id and text; a prototype is one vector, whatever the corpus size.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"))
    d = d.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    parts = 1 << 30
    limit = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, int(parts * min(1.0, train_docs / n)))])
    drawn = d.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < limit[F.col("label")]).select("label", "text")
    schema = pa.schema([("label", pa.string()), ("v", pa.list_(pa.float64()))])

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in _in_groups(batches):
            v = _units(profiles(texts_of(batch), dimensions)).astype(np.float64)
            for row, label in zip(v, batch.column("label").to_pylist()):
                total[label] = total.get(label, 0) + row
        yield record_batch(schema, {"label": list(total), "v": list(total.values())})

    sums = (drawn.mapInArrow(bundle, "label string, v array<double>").select("label", F.posexplode("v"))
            .groupBy("label", "pos").agg(F.sum("col").alias("x")))
    out = {label: np.zeros(dimensions) for label in sizes}
    for r in sums.collect():  # languages x dimensions
        out[r["label"]][r["pos"]] = r["x"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score (largest cosine, at least 0) of every row.

    ``und`` and 0 for a null text, a text without letters, or if nothing was
    learned.  Equal cosines go to the first language in text order.  Only the
    text is an input.
    """
    judge = _judge(prototypes, dimensions)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in _in_groups(batches):
            lang, score = judge(texts_of(batch))
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score})

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _judge(prototypes: dict[str, np.ndarray], dimensions: int):
    langs = sorted(prototypes)
    known = _units(np.stack([prototypes[k] for k in langs])).astype(np.float32) if langs else None

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        v = profiles(texts, dimensions)
        some, cosine = v.any(axis=1), _units(v) @ known.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(v)), best], 0, 1).astype(np.float64) * some
        return [langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], score

    return judge


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = 0.0, text_col: str = "text",
                    dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is found with at least ``min_score``.

    Texts that are null or without letters go.  Where nothing was learned, no
    text with a letter is rejected.  A learned language named ``und`` counts as not found.
    Judged row by row, so rows are neither moved nor joined.
    """
    judge = _judge(prototypes, dimensions) if prototypes else lambda texts: (
        ["" if some else UNKNOWN for some in profiles(texts, dimensions).any(axis=1)], np.full(len(texts), np.inf))

    def run(batches):
        for batch in _in_groups(batches, text_col=text_col):
            lang, score = judge(texts_of(batch, text_col))
            yield batch.filter(pa.array([k != UNKNOWN and s >= min_score for k, s in zip(lang, score.tolist())], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return id_remainder("doc_id", 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """Predictions of every document by prototypes of those that are not held out."""
    found = predict(docs, train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

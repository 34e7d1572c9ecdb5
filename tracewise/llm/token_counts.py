"""Token counts by section (operator 9): offset-mapped attribution."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codecs import Codec, codec
from .common import narrow, text_slices, texts_of

RULES = ("start", "end", "majority")
_OUT = pa.schema([("doc_id", pa.int64()), ("section_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()),
                  ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("token_share", pa.float64())])
_DDL = ("doc_id long, section_no int, char_start long, char_end long, n_tokens long, n_crossing long, "
        "token_share double")


def token_spans(c: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character span [start, end) of each token of one whole text.

    A byte-level token stands for bytes of the text in order, so byte spans
    are running sums of token sizes and character spans follow from the
    characters' first bytes.  A token with part of a character's bytes spans
    that character.
    """
    if c.route != "ranks":
        spans = np.array(c.library.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]
    ends = np.cumsum(c.token_bytes[c.encode(text)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    if text.isascii():
        return starts, ends
    first = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    return first[starts] - 1, first[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, boundary-crossing tokens and fractional share of each section.

    ``bounds``: section limits, ascending; section k covers [bounds[k], bounds[k+1]).
    Interval join by binary search.  A crossing token goes whole to the section
    with its first character (``start``), its last one (``end``) or most of its
    characters, the earlier at a tie (``majority``); the share splits it by characters.
    """
    n = len(bounds) - 1
    limits = bounds[1:]
    a = np.searchsorted(limits, starts, side="right")
    b = np.searchsorted(limits, np.maximum(ends - 1, starts), side="right")
    own, cross = a if rule != "end" else b, np.flatnonzero(a != b)
    share = np.bincount(a[a == b], minlength=n).astype(np.float64)
    touched = np.zeros(n, dtype=np.int64)
    own = own.copy()
    for i in cross.tolist():
        k = np.arange(a[i], b[i] + 1)
        part = np.minimum(ends[i], bounds[k + 1]) - np.maximum(starts[i], bounds[k])
        share[k] += part / (ends[i] - starts[i])
        touched[k] += part > 0
        if rule == "majority":
            own[i] = k[int(np.argmax(part))]
    return np.bincount(own, minlength=n), touched, share


def section_bounds(text: str, separator: re.Pattern) -> np.ndarray:
    """Sections end after each separator match; a text without any is one section."""
    cuts = [m.end() for m in separator.finditer(text) if 0 < m.end() < len(text)]
    return np.array([0, *cuts, len(text)], dtype=np.int64)


def section_token_counts(docs: DataFrame, tokenizer: str, separator: str = r"\n", rule: str = "majority",
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section with its tokens.

    Each whole text is encoded once; counts of a document's sections sum to
    the document's tokens for every rule, and shares sum to the same.  A null
    or empty text has one empty section (0, 0) without tokens.  Repeated rows
    give their rows each; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        c, sep = codec(tokenizer), re.compile(separator)
        for batch in text_slices(batches, 4 << 20):
            cols = [[] for _ in range(6)]
            ids, reps = batch.column("doc_id"), []
            for text in texts_of(batch):
                bounds = section_bounds(text, sep)
                s, e = token_spans(c, text)
                n, crossing, share = attribute(s, e, bounds, rule)
                reps.append(len(bounds) - 1)
                for col, v in zip(cols, (np.arange(len(bounds) - 1), bounds[:-1], bounds[1:], n, crossing, share)):
                    col.append(v)
            take = pa.array(np.repeat(np.arange(len(reps)), reps))
            data = [pa.array(np.concatenate(v)).cast(f.type) for v, f in zip(cols, list(_OUT)[1:])]
            yield pa.RecordBatch.from_arrays([ids.take(take), *data], schema=_OUT)

    return narrow(docs, id_col, text_col).mapInArrow(run, _DDL)

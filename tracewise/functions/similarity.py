"""Ratcliff-Obershelp similarity of many string pairs at once.

The ratio is 2 M / (len(a) + len(b)), where M adds up the longest common
block of both strings (earliest in a, then in b), the longest common blocks
left of it, right of it, and so on.  It is not symmetric.  For second strings of
200 characters or more, characters above one in a hundred (plus one) start no
block, they only extend one.

A batch of pairs is worked off in rounds.  Each round finds the longest common
block of every open (a part, b part) segment by one pass over all their cells,
one character of a at a time, and opens the segments on both sides of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LONG = 200  # from this length on, common characters of the second string start no block
_CELLS = 1 << 20
_PAD, _COMMON = -1, -2


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings in a row, their starts and their lengths."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return flat, np.cumsum(size) - size, size


def _without_common(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = flat.copy()
    for s, n in zip(start[size >= LONG], size[size >= LONG]):
        part = flat[s:s + n]
        _, which, many = np.unique(part, return_inverse=True, return_counts=True)
        out[s:s + n][many[which] > n // 100 + 1] = _COMMON
    return out


def _longest(a: np.ndarray, b: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of each segment's longest common block; segments (alo, ahi, blo, bhi) by falling a length."""
    alo, ahi, blo, bhi = seg.T
    na, nb = ahi - alo, bhi - blo
    row = np.cumsum(nb + 1) - (nb + 1)  # each segment's cells follow one empty cell
    owner = np.repeat(np.arange(len(seg)), nb + 1)
    at = np.arange(len(owner)) - row[owner]
    cells = np.where(at > 0, b[np.maximum(blo[owner] + at - 1, 0)], _PAD)
    run = np.zeros(len(owner), np.int64)
    best, best_i, best_j = np.zeros(len(seg), np.int64), alo.copy(), blo.copy()
    live = np.searchsorted(-na, -np.arange(na[0]), side="left")  # segments that still have a character i
    for i, k in enumerate(live):
        end = row[k - 1] + nb[k - 1] + 1
        grown = np.zeros(end, np.int64)
        grown[1:] = run[:end - 1] + 1
        grown[cells[:end] != np.repeat(a[alo[:k] + i], nb[:k] + 1)] = 0
        run = grown
        most = np.maximum.reduceat(run, row[:k])
        up = np.flatnonzero(most > best[:k])
        if len(up):
            best[up] = most[up]
            best_i[up] = alo[up] + i - most[up] + 1
            first = np.minimum.reduceat(np.where(run == most[owner[:end]], at[:end], 1 << 60), row[:k])
            best_j[up] = blo[up] + first[up] - most[up]
    return best_i, best_j, best


def _extended(a, b, seg, i, j, k, which):
    """Blocks of long second strings grow over equal neighbours, common characters included."""
    for s in which:
        alo, ahi, blo, bhi = seg[s]
        while i[s] > alo and j[s] > blo and a[i[s] - 1] == b[j[s] - 1]:
            i[s], j[s], k[s] = i[s] - 1, j[s] - 1, k[s] + 1
        while i[s] + k[s] < ahi and j[s] + k[s] < bhi and a[i[s] + k[s]] == b[j[s] + k[s]]:
            k[s] += 1


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The ratio of each pair; two empty strings have 1."""
    a, a0, na = _codes(left)
    b, b0, nb = _codes(right)
    starts = _without_common(b, b0, nb)
    matched = np.zeros(len(left), np.int64)
    pair = np.flatnonzero((na > 0) & (nb > 0))
    seg = np.stack([a0, a0 + na, b0, b0 + nb], axis=1)[pair]
    while len(pair):
        order = np.argsort(seg[:, 0] - seg[:, 1], kind="stable")
        pair, seg = pair[order], seg[order]
        cuts = np.cumsum(seg[:, 3] - seg[:, 2] + 1) // _CELLS
        next_pair, next_seg = [], []
        for c in np.unique(cuts):
            p, s = pair[cuts == c], seg[cuts == c]
            i, j, k = _longest(a, starts, s)
            _extended(a, b, s, i, j, k, np.flatnonzero(nb[p] >= LONG))
            np.add.at(matched, p, k)
            for side in (np.stack([s[:, 0], i, s[:, 2], j], axis=1), np.stack([i + k, s[:, 1], j + k, s[:, 3]], axis=1)):
                more = (k > 0) & (side[:, 0] < side[:, 1]) & (side[:, 2] < side[:, 3])
                next_pair.append(p[more])
                next_seg.append(side[more])
        pair, seg = np.concatenate(next_pair), np.concatenate(next_seg)
    total = na + nb
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[both] = ratios([x.lower() for x in a[both]], [x.lower() for x in b[both]])
    return pd.Series(out, dtype="float64").where(both, None)


def similarity(a: Column, b: Column) -> Column:
    """ratio(lower(a), lower(b)) (T4); null if either is."""
    return _ratio(a, b)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Upper bound test: ratio = 2M/(la+lb) and M <= min(la, lb)."""
    la, lb = F.length(a), F.length(b)
    return (F.lit(2.0) * F.least(la, lb)) >= F.lit(threshold) * (la + lb)

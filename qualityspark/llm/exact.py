"""Whole-number vectors and exact inner products of any size.

A tile of two blocks is multiplied as doubles while every partial sum is a whole number a double
holds, as longs while it fits a long, and as Python integers beyond.  A score beyond
a long is carried as the nearest long plus a text that sorts like the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
#: beyond any inner product of doubles of a length that fits memory
SHIFT = 10 ** 640
DIGITS = 641


def whole(v: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as doubles."""
    return F.transform(v, lambda c: _floor(c.cast("double") * F.lit(float(scale))))


def _floor(x: Column) -> Column:
    # floor() gives a long, which ends at 2**63; doubles from 2**53 on are whole already
    return F.when(F.abs(x) < float(1 << 53), F.floor(F.when(F.abs(x) < float(1 << 53), x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


def usable(v: Column, scale: int) -> Column:
    """Whether a vector has only finite components, also when scaled."""
    def bad(c):
        x = c.cast("double") * F.lit(float(scale))
        return c.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad)


def matrices(lists) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of doubles) per length of an Arrow list array."""
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    dims = np.diff(off)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, flat[(off[at][:, None] + np.arange(d)[None]).ravel().astype(np.int64)].reshape(len(at), int(d))


def pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a kind of number in which their products are exact."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return a, b
    if top <= LONG:
        return a.astype(np.int64), b.astype(np.int64)
    return integers(a), integers(b)


def integers(a: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as Python integers."""
    out = np.empty(a.shape, object)
    out.ravel()[:] = [int(x) for x in a.ravel().tolist()]
    return out


def shown(scores) -> tuple[list[int], list[str | None]]:
    """Scores as longs, and a sortable text of those at or beyond the ends of a long."""
    shown = [max(-LONG - 1, min(LONG, int(s))) for s in scores]
    return shown, [None if -LONG - 1 < s < LONG else str(int(x) + SHIFT).zfill(DIGITS) for s, x in zip(shown, scores)]


def read(score, big):
    """The score of ``shown``."""
    return int(big) - SHIFT if big is not None else score

"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` treating NULL keys as equal (group keys such as
    an optional split year may be NULL).  ``<=>`` keys are still hash / sort
    merge join keys for the planner.  Output has one copy of each key."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_keys needs at least one key")
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else (cond & c)
    j = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return j
    return j.drop(*[f"__r_{k}" for k in keys])

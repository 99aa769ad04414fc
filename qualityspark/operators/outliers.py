"""Month-wise IQR clipping.

Bounds are computed for every (feature, calendar month) from exact quartiles
(years pooled); a cell is skipped when it has fewer than 4 values or a zero /
undefined IQR.  Values are clipped to [q1 - k*IQR, q3 + k*IQR]; values exactly
on a bound are not outliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.functions.numeric import clip
from qualityspark.operators.ranks import quantiles_wide


def to_long(df: DataFrame, columns, ids=(), feature="feature", value="value") -> DataFrame:
    """Unpivot numeric columns to (ids..., feature, value)."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), feature, value)


def monthwise_iqr_bounds(df: DataFrame, columns, month_col: str = "month", k: float = 1.5,
                         min_count: int = 4) -> DataFrame:
    """(feature, month, n, q1, q3, lower, upper) for cells that get clipped."""
    long = to_long(df, columns, ids=[month_col])
    q = quantiles_wide(long, ["feature", month_col], "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.where((F.col("n") >= min_count) & iqr.isNotNull() & (iqr != 0)).select(
        "feature", F.col(month_col).alias("month"), "n", "q1", "q3",
        (F.col("q1") - F.lit(k) * iqr).alias("lower"),
        (F.col("q3") + F.lit(k) * iqr).alias("upper"))


def _bounds_by_month(bounds: DataFrame, columns) -> DataFrame:
    """One row per month with lower/upper per column.  At most 12 rows (one per
    calendar month) whatever the data size, so broadcasting it is safe."""
    aggs = []
    for c in columns:
        aggs.append(F.max(F.when(F.col("feature") == c, F.col("lower"))).alias(f"_lo_{c}"))
        aggs.append(F.max(F.when(F.col("feature") == c, F.col("upper"))).alias(f"_hi_{c}"))
    return bounds.groupBy(F.col("month").alias("_bm")).agg(*aggs)


def apply_bounds(df: DataFrame, bounds: DataFrame, columns, month_col: str = "month") -> DataFrame:
    """Clip ``columns``; months or columns without bounds stay untouched."""
    b = F.broadcast(_bounds_by_month(bounds, columns))
    j = df.join(b, df[month_col] == b["_bm"], "left")
    out = j.withColumns({c: clip(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in columns})
    return out.drop("_bm", *[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


def outlier_counts(df: DataFrame, bounds: DataFrame, columns, month_col: str = "month") -> DataFrame:
    """(feature, n_outliers): strict outliers per column, months pooled."""
    b = F.broadcast(_bounds_by_month(bounds, columns))
    j = df.join(b, df[month_col] == b["_bm"], "left")
    aggs = [F.count_if((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")))
            .alias(c) for c in columns]
    wide = j.agg(*aggs)
    return to_long(wide, columns, feature="feature", value="n_outliers").select(
        "feature", F.col("n_outliers").cast("long").alias("n_outliers"))


def iqr_clip_by_month(df: DataFrame, columns, month_col: str = "month", k: float = 1.5):
    """Reference-shaped entry point: (clipped frame, outlier counts, bounds)."""
    bounds = monthwise_iqr_bounds(df, columns, month_col, k)
    return apply_bounds(df, bounds, columns, month_col), outlier_counts(df, bounds, columns, month_col), bounds

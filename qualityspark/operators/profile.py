"""Distribution profiles.

Columns are unpivoted once to (feature, value) and every statistic is one
grouped aggregate over that long frame, so adding a column adds rows, not
passes.  Quantiles go through the exact distributed engine in ``ranks``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.operators.outliers import to_long
from qualityspark.operators.ranks import quantiles_wide


def _moments(long: DataFrame, keys) -> DataFrame:
    v = F.col("value")
    valid = v.isNotNull() & ~F.isnan(v)
    x = F.when(valid, v)
    return long.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.count_if(~valid | v.isNull()).alias("n_missing"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.skewness(x).alias("_g1"),
        F.kurtosis(x).alias("_g2"),
        F.var_pop(x).alias("_m2"),
    )


def _unbiased_shape(n, g1, g2, m2):
    """Population g1/g2 -> adjusted Fisher-Pearson skew G1 and excess kurtosis G2.

    Constant columns give 0.0, as pandas does; n < 3 (skew) / n < 4 (kurt) NULL.
    """
    nd = n.cast("double")
    skew = (F.when(n < 3, F.lit(None).cast("double"))
            .when(m2 == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(nd * (nd - 1)) / (nd - 2)))
    kurt = (F.when(n < 4, F.lit(None).cast("double"))
            .when(m2 == 0, F.lit(0.0))
            .otherwise((nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6)))
    return skew, kurt


def descriptive_stats(df: DataFrame, columns) -> DataFrame:
    """A1: feature, non_null_count, missing_count, mean, std, min, q25, median,
    q75, max, skew, kurtosis."""
    long = to_long(df, columns)
    m = _moments(long, ["feature"])
    q = quantiles_wide(long, ["feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    j = m.join(q.drop("n"), "feature", "left")
    skew, kurt = _unbiased_shape(F.col("n"), F.col("_g1"), F.col("_g2"), F.col("_m2"))
    return j.select(
        "feature", F.col("n").cast("long").alias("non_null_count"),
        F.col("n_missing").cast("long").alias("missing_count"),
        "mean", "std", "min", "q25", "median", "q75", "max",
        skew.alias("skew"), kurt.alias("kurtosis"))


def monthly_boxplot_stats(df: DataFrame, columns, month_col: str = "month") -> DataFrame:
    """A2: per (feature, month): n, min, q1, median, q3, max, mean, std
    (std 0.0 for a single value); empty cells absent."""
    long = to_long(df, columns, ids=[month_col])
    m = _moments(long, ["feature", month_col]).where(F.col("n") > 0)
    q = quantiles_wide(long, ["feature", month_col], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = m.join(q.drop("n"), ["feature", month_col], "left")
    return j.select(
        "feature", F.col(month_col).alias("month"), F.col("n").cast("long").alias("n"),
        "min", "q1", "median", "q3", "max", "mean",
        F.coalesce(F.col("std"), F.lit(0.0)).alias("std"))


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """(feature, n_missing, n_rows) for every column, one pass."""
    columns = list(columns or df.columns)
    dtypes = dict(df.dtypes)

    def miss(c):
        col = F.col(c)
        cond = col.isNull()
        if dtypes[c] in ("double", "float"):
            cond = cond | F.isnan(col)
        return F.count_if(cond).alias(c)

    wide = df.agg(*[miss(c) for c in columns], F.count(F.lit(1)).alias("__n"))
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("n_missing")) for c in columns
    ])).alias("s"), F.col("__n").alias("n_rows"))
    return stacked.select("s.feature", "s.n_missing", F.col("n_rows").cast("long"))


#: words of a year filter that mean every year
EVERY_YEAR = ("all", "*")


def parse_year_filter(value) -> list[int] | None:
    """Years of a list or of a text separated by commas, semicolons or
    blanks; nothing or one of ``EVERY_YEAR`` means no filter (None)."""
    if isinstance(value, str):
        words = re.findall(r"[^\s,;]+", value)
        words = [] if [w.lower() for w in words] in [[w] for w in EVERY_YEAR] else words
    else:
        words = value if value is not None else []
    return sorted(set(map(int, words))) or None


def filter_years(df: DataFrame, years, date_col: str = "date") -> DataFrame:
    """Year filter as a date range per year so it prunes partitions / pushes
    down to the scan instead of evaluating year() on every row."""
    if not years:
        return df
    d = F.col(date_col)
    cond = None
    for y in years:
        c = (d >= F.lit(f"{y}-01-01").cast("timestamp_ntz" if dict(df.dtypes)[date_col] == "timestamp_ntz"
                                           else "timestamp")) & \
            (d < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz" if dict(df.dtypes)[date_col] == "timestamp_ntz"
                                               else "timestamp"))
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def ingest_metadata(before: DataFrame, after: DataFrame, date_col: str = "date",
                    source_col: str | None = None) -> DataFrame:
    """One row with rows before/after the year filter and years present."""
    b = before.agg(F.count(F.lit(1)).alias("rows_loaded_before_year_filter"),
                   *([F.array_join(F.array_sort(F.collect_set(source_col)), ",").alias("source_files")]
                     if source_col else []))
    a = after.agg(
        F.count(F.lit(1)).alias("rows_after_year_filter"),
        F.array_join(F.array_sort(F.collect_set(F.year(date_col))), ",").alias("years_present"),
        F.min(date_col).alias("date_min"), F.max(date_col).alias("date_max"))
    return b.crossJoin(a)

"""Correlations and normality tests.

* Pearson (D3): pairwise-complete; every pair is a ``covar_samp / (sd*sd)`` of
  the same one aggregate, divisions through ``try_divide`` (a constant column
  gives NULL instead of an ANSI error).
* Spearman (D4): Pearson of average ranks, where the ranks of a pair are
  taken over the rows on which both columns are present.  Pairs whose
  complete-row sets coincide share one set of ranks (one rank pass per
  distinct null signature, not per pair).  Ranks come from the exact
  distributed rank engine.
* D'Agostino-Pearson K^2 (D2) from the first four moments, as expressions.
* Shapiro-Wilk (D1) only applies to 8 <= n <= 5000, i.e. to bounded groups:
  it runs per feature in ``applyInPandas`` with at most 5000 values.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.operators.outliers import to_long
from qualityspark.operators.ranks import weighted_ranks
from qualityspark.operators.tails import norm_ppf, norm_sf

SHAPIRO_MAX_N = 5000


def _nn(c):
    col = F.col(c)
    return col.isNotNull() & ~F.isnan(col)


def _pair_corr(a: Column, b: Column, both: Column) -> Column:
    x, y = F.when(both, a), F.when(both, b)
    den = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), F.when(den > 0, den))


def _matrix(df: DataFrame, columns, col_of, both_of) -> DataFrame:
    aggs = []
    pairs = list(itertools.combinations(columns, 2))
    for a, b in pairs:
        aggs.append(_pair_corr(col_of(a, b, a), col_of(a, b, b), both_of(a, b)).alias(f"{a}__{b}"))
    for c in columns:
        s = F.stddev_samp(F.when(_nn(c), F.col(c)))
        aggs.append(F.when(s > 0, F.lit(1.0)).alias(f"{c}__{c}"))
    wide = df.agg(*aggs)
    entries = []
    for a, b in pairs:
        entries += [(a, b, f"{a}__{b}"), (b, a, f"{a}__{b}")]
    entries += [(c, c, f"{c}__{c}") for c in columns]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(k).cast("double").alias("r"))
        for a, b, k in entries])).alias("e")).select("e.*")


def pearson_matrix(df: DataFrame, columns) -> DataFrame:
    """(feature_a, feature_b, r) over every ordered pair, pairwise complete."""
    return _matrix(df, columns, lambda a, b, c: F.col(c), lambda a, b: _nn(a) & _nn(b))


def spearman_matrix(df: DataFrame, columns, nullable: list[str] | None = None) -> DataFrame:
    """Spearman over every ordered pair.  ``nullable`` (columns that contain
    NULL/NaN) decides which pairs share complete-row sets; when not given it is
    read with one small aggregate.  All (signature, column) rank sets come
    from ONE rank-engine pass over the value counts of a long (row, feature, value) frame, which
    has a row and feature once; a value's ranks under all signatures are joined to it
    together and brought back per row for the correlation aggregate."""
    from qualityspark.session import materialize
    columns = list(columns)
    # stable row ids: written once, so a recomputed task sees the same ids
    rows = materialize(df.select(*columns).withColumn("_rid", F.monotonically_increasing_id()))
    if nullable is None:
        cnt = rows.agg(*[F.count_if(~_nn(c)).alias(c) for c in columns]).first()
        nullable = [c for c in columns if cnt[c] > 0]
    pairs = list(itertools.combinations(columns, 2))
    sig_of = {(a, b): "|".join(sorted({a, b} & set(nullable))) for a, b in pairs}
    sigs = sorted(set(sig_of.values()))
    # which signatures a feature is ranked under, and which a row counts for
    used = {c: [i for i, s in enumerate(sigs) if any(sg == s and c in p for p, sg in sig_of.items())] for c in columns}

    def complete(sig):
        cond = F.lit(True)
        for c in [x for x in sig.split("|") if x]:
            cond = cond & _nn(c)
        return cond

    masked = rows.withColumns({f"_in{i}": complete(s).cast("int") for i, s in enumerate(sigs)})
    flags = [f"_in{i}" for i in range(len(sigs))]
    # a row and feature once, whatever the number of signatures; counted per value and then split by signature
    long = to_long(masked, columns, ids=["_rid", *flags]).where(_nn("value"))
    counts = long.groupBy("feature", "value").agg(*[F.sum(f).cast("long").alias(f) for f in flags])
    wanted = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(i) for i in used[c]]).cast("array<int>"))])
    split = counts.select("feature", "value", F.explode(F.transform(
        wanted[F.col("feature")], lambda i: F.struct(i.alias("_sig"), F.element_at(F.array(*flags), i + 1).alias("_w")))).alias("s"))
    split = split.select(F.col("s._sig").alias("_sig"), "feature", "value", F.col("s._w").alias("_w")).where("_w > 0")
    ranks = weighted_ranks(split, ["_sig", "feature"], "value")
    ranks = ranks.groupBy("feature", "value").pivot("_sig", list(range(len(sigs)))).agg(F.first("_rank"))
    ranks = ranks.withColumnsRenamed({str(i): f"_r{i}" for i in range(len(sigs))})
    ranked = long.select("_rid", "feature", "value").join(ranks, ["feature", "value"])
    cell = lambda c, i: F.max(F.when(F.col("feature") == c, F.col(f"_r{i}"))).alias(f"_{columns.index(c)}_{i}")
    wide = ranked.groupBy("_rid").agg(*[cell(c, i) for c in columns for i in used[c]])
    out = []
    for a, b in pairs:
        i = sigs.index(sig_of[(a, b)])
        x, y = (F.col(f"_{columns.index(c)}_{i}") for c in (a, b))
        both = x.isNotNull() & y.isNotNull()                # such a row is complete for the pair's signature
        out.append(_pair_corr(x, y, both).alias(f"{a}__{b}"))
    for c in columns:
        s = F.stddev_samp(F.when(_nn(c), F.col(c)))
        out.append(s.alias(f"_sd_{c}"))
    agg = wide.agg(*out[:len(pairs)]).crossJoin(rows.agg(*out[len(pairs):]))
    ent = []
    for a, b in pairs:
        ent += [(a, b, F.col(f"{a}__{b}")), (b, a, F.col(f"{a}__{b}"))]
    ent += [(c, c, F.when(F.col(f"_sd_{c}") > 0, F.lit(1.0))) for c in columns]
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), v.cast("double").alias("r"))
        for a, b, v in ent])).alias("e")).select("e.*")


# --------------------------------------------------------------------------- D2
def moments(df: DataFrame, columns) -> DataFrame:
    """(feature, n, m2, m3, m4, mean): population central moments per column."""
    long = to_long(df, columns)
    v = F.when(_nn("value"), F.col("value"))
    g = long.groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("m2"),
        F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"))
    # m3 = g1 * m2^1.5, m4 = (g2 + 3) * m2^2
    return g.select("feature", "n", "mean", "m2",
                    (F.col("_g1") * F.pow("m2", 1.5)).alias("m3"),
                    ((F.col("_g2") + 3) * F.col("m2") * F.col("m2")).alias("m4"))


def dagostino_k2(n: Column, m2: Column, m3: Column, m4: Column) -> tuple[Column, Column]:
    """K^2 statistic and p-value (2 degrees of freedom: p = exp(-K^2/2))."""
    nd = n.cast("double")
    b1 = m3 / F.pow(m2, 1.5)
    y = b1 * F.sqrt((nd + 1) * (nd + 3) / (6.0 * (nd - 2)))
    beta2 = 3.0 * (nd * nd + 27 * nd - 70) * (nd + 1) * (nd + 3) / ((nd - 2) * (nd + 5) * (nd + 7) * (nd + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    zs = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    b2 = m4 / (m2 * m2)
    e = 3.0 * (nd - 1) / (nd + 1)
    varb2 = 24.0 * nd * (nd - 2) * (nd - 3) / ((nd + 1) * (nd + 1) * (nd + 3) * (nd + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (nd * nd - 5 * nd + 2) / ((nd + 7) * (nd + 9)) * F.sqrt(6.0 * (nd + 3) * (nd + 5) / (nd * (nd - 2) * (nd - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    den = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(den) * F.when(den != 0, F.pow((1 - 2 / a) / F.abs(den), 1 / 3.0))
    zk = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    k2 = zs * zs + zk * zk
    return k2, F.exp(-k2 / 2)


# --------------------------------------------------------------------------- D1
# Fixed coefficients of Royston's (1992, 1995) Shapiro-Wilk approximation.
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p-value for 3 <= n <= 5000 (Royston's algorithm)."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        i = np.arange(1, n + 1)
        m = np.array([norm_ppf((k - 0.375) / (n + 0.25)) for k in i])
        mm = float(np.sum(m * m))
        u = 1.0 / math.sqrt(n)
        a = np.zeros(n)
        an = m[-1] / math.sqrt(mm) + _poly(_C1, u)
        if n > 5:
            an1 = m[-2] / math.sqrt(mm) + _poly(_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
            a[-1], a[0] = an, -an
    d = x - x.mean()
    ssq = float(np.sum(d * d))
    if ssq == 0:
        return 1.0, 1.0
    w = min(float(np.dot(a, x)) ** 2 / ssq, 1.0)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, min(p, 1.0)
    w1 = math.log1p(-w) if w < 1 else float("-inf")
    if n <= 11:
        gamma = _poly(_G, n)
        if w1 >= gamma:   # outside the approximation's range: W so small p is ~0
            return w, 1e-99
        mu, sigma = _poly(_C3, n), math.exp(_poly(_C4, n))
        z = (-math.log(gamma - w1) - mu) / sigma
    else:
        ln = math.log(n)
        mu, sigma = _poly(_C5, ln), math.exp(_poly(_C6, ln))
        z = (w1 - mu) / sigma
    return w, norm_sf(z)


def normality_report(df: DataFrame, columns, max_shapiro: int = SHAPIRO_MAX_N) -> DataFrame:
    """D1 + D2: (feature, n_obs, test, stat, p_value, is_normal_at_0_05).
    n < 8: no test; 8 <= n <= 5000: Shapiro-Wilk on the (bounded) group;
    n > 5000: K^2 from moments."""
    mo = moments(df, columns)
    k2, pk = dagostino_k2(F.col("n"), F.col("m2"), F.col("m3"), F.col("m4"))
    big = mo.where(F.col("n") > max_shapiro).select(
        "feature", F.col("n").cast("long").alias("n_obs"), F.lit("dagostino_k2").alias("test"),
        k2.alias("stat"), pk.alias("p_value"))
    small_feats = mo.where((F.col("n") >= 8) & (F.col("n") <= max_shapiro)).select("feature")
    long = to_long(df, columns).where(_nn("value"))
    # only groups of at most max_shapiro values reach applyInPandas
    sw_in = long.join(F.broadcast(small_feats), "feature", "left_semi")

    def _sw(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "n_obs": [len(pdf)], "test": ["shapiro"],
                             "stat": [w], "p_value": [p]})

    sw = sw_in.groupBy("feature").applyInPandas(
        _sw, "feature string, n_obs long, test string, stat double, p_value double")
    none = mo.where(F.col("n") < 8).select(
        "feature", F.col("n").cast("long").alias("n_obs"), F.lit(None).cast("string").alias("test"),
        F.lit(None).cast("double").alias("stat"), F.lit(None).cast("double").alias("p_value"))
    out = big.unionByName(sw).unionByName(none)
    return out.withColumn("is_normal_at_0_05", F.when(F.col("p_value").isNotNull(), F.col("p_value") >= 0.05))


def primary_method(normality: DataFrame) -> DataFrame:
    """Pearson only if every tested column is normal."""
    return normality.agg(F.when(F.count("is_normal_at_0_05") > 0,
                                F.when(F.bool_and(F.col("is_normal_at_0_05")), F.lit("pearson")))
                         .otherwise(F.lit(None)).alias("_m")).select(
        F.coalesce(F.col("_m"), F.lit("spearman")).alias("correlation_primary_method"))

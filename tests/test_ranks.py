"""Exact distributed quantiles / ranks vs numpy and pandas (brackets and bins of several sizes)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualityspark.operators.ranks import average_ranks, quantiles, quantiles_wide


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    g = rng.choice(["a", "b", "c"], 500, p=[0.6, 0.3, 0.1])     # a skewed group
    v = np.round(rng.lognormal(2, 1, 500), 2)                    # ties included
    v[:5] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    sdf = spark.createDataFrame(pdf.replace({np.nan: None}), "g string, v double")
    return pdf, sdf


@pytest.mark.parametrize("accuracy", [5, 60, 10_000])
def test_quantiles_match_numpy(data, accuracy):
    pdf, sdf = data
    got = quantiles(sdf, ["g"], "v", [0.0, 0.25, 0.5, 0.8, 1.0], accuracy=accuracy).toPandas()
    for (g, p), row in got.set_index(["g", "prob"]).iterrows():
        exp = pdf.loc[pdf.g == g, "v"].dropna().quantile(p)
        assert row["quantile"] == pytest.approx(exp, rel=1e-12, abs=1e-12)
        assert row["n"] == pdf.loc[pdf.g == g, "v"].notna().sum()


def test_global_quantiles(data):
    pdf, sdf = data
    got = quantiles_wide(sdf, [], "v", {"q1": 0.25, "q3": 0.75}, accuracy=8).first()
    assert got["q1"] == pytest.approx(pdf.v.dropna().quantile(0.25))
    assert got["q3"] == pytest.approx(pdf.v.dropna().quantile(0.75))


@pytest.mark.parametrize("max_bin", [5, 200_000])
def test_average_ranks(data, max_bin):
    pdf, sdf = data
    got = average_ranks(sdf, ["g"], "v", max_bin=max_bin).toPandas()
    for g, part in pdf.dropna().groupby("g"):
        exp = part.assign(r=part.v.rank(method="average")).drop_duplicates("v").set_index("v")["r"]
        mine = got[got.g == g].set_index("v")["_rank"]
        pd.testing.assert_series_equal(mine.sort_index(), exp.sort_index(), check_names=False)


def test_bins_stay_bounded_on_skewed_values(spark):
    """A few huge values do not widen the bins (20,000 values, limit 100)."""
    from qualityspark.operators.ranks import bin_table, cumulative, value_counts
    sdf = spark.range(20_000).selectExpr("cast(CASE WHEN id < 10 THEN id * 1e12 ELSE id / 7 END AS double) AS v", "0 AS g")
    bins = bin_table(cumulative(value_counts(sdf, ["g"], "v"), ["g"], "v", 100), ["g"]).toPandas()
    assert bins["_bw"].max() <= 100 and bins["_bw"].sum() == 20_000


def test_quantiles_large_group_uses_brackets(spark):
    sdf = spark.range(5_000).selectExpr("cast(pow(id % 977, 2) as double) AS v")
    got = quantiles(sdf, [], "v", [0.0, 0.1, 0.5, 0.9, 1.0], accuracy=100).toPandas().set_index("prob")["quantile"]
    v = np.array([float(i % 977) ** 2 for i in range(5_000)])
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(v, p))


@pytest.mark.parametrize("keys", [
    [5, 5, 5, 5], [], [-(1 << 63), (1 << 63) - 1, 0, -1, 1], list(range(-50, 50)), [7] * 100 + list(range(100)),
    [(i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for i in range(3000)], [(1 << 40) + i % 3 for i in range(50)]])
def test_values_at_ranks(spark, keys):
    from qualityspark.operators.ranks import values_at_ranks
    sdf = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    want = sorted(keys)
    ranks = lambda n: [0, n // 3, n // 2, n // 2, n - 1, n, -1]
    n, got = values_at_ranks(sdf, F.col("k"), ranks)
    assert n == len(keys) and got == [want[r] if 0 <= r < n else None for r in ranks(n)]


def test_folds_by_cut_values(spark):
    """Split and folds equal a ranking of the keys, equal keys together; no row moves."""
    from qualityspark.operators.models import with_folds
    keys = [(i * 7919) % 211 for i in range(500)]
    sdf = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    out = with_folds(sdf, F.col("k"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    n, n_test = 500, 100
    for r in out.collect():
        before = sum(k < r.k for k in keys)
        assert r.split == ("test" if before < n_test else "train")
        assert r.fold == (None if before < n_test else (before - n_test) * 5 // (n - n_test))

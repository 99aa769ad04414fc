"""Closed-form checks: Gram OLS / VIF vs numpy, tails vs published tables,
Shapiro-Wilk sanity, K^2 formula vs a direct numpy evaluation."""

import math

import numpy as np
import pandas as pd
import pytest

from qualityspark.operators.correlation import shapiro_wilk
from qualityspark.operators.gram import gram, ols_from_gram, select_by_vif, vif_from_gram
from qualityspark.operators.tails import chi2_sf, f_sf, t_sf2


def test_tails_published_values():
    # two-sided t: t=2.228, df=10 -> 0.05; t=1.96, df=inf-ish -> 0.05
    assert t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_sf2(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert t_sf2(0.0, 5) == pytest.approx(1.0)
    # F(2, 10) at 4.102821 -> 0.05 ; chi2(2) at 5.991465 -> 0.05 ; chi2(1) at 3.841459 -> 0.05
    assert f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)


@pytest.fixture(scope="module")
def reg(spark):
    rng = np.random.default_rng(3)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    x3 = 0.7 * x1 + 0.3 * rng.normal(size=n)
    y = 1.5 + 2 * x1 - x2 + 0.5 * x3 + rng.normal(scale=0.5, size=n)
    x2[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"y": y, "x1": x1, "x2": x2, "x3": x3, "k": np.ones(n)})
    sdf = spark.createDataFrame(pdf.replace({np.nan: None}), "y double, x1 double, x2 double, x3 double, k double")
    return pdf, sdf


def test_ols_matches_lstsq(reg):
    pdf, sdf = reg
    g = gram(sdf, ["y", "x1", "x2", "x3", "k"])
    res = ols_from_gram(g, "y", ["x1", "x2", "x3"])
    c = pdf.dropna()
    X = np.column_stack([np.ones(len(c)), c[["x1", "x2", "x3"]].to_numpy()])
    beta, *_ = np.linalg.lstsq(X, c.y.to_numpy(), rcond=None)
    got = [res.coef[v] for v in ["const", "x1", "x2", "x3"]]
    np.testing.assert_allclose(got, beta, rtol=1e-9)
    resid = c.y.to_numpy() - X @ beta
    r2 = 1 - resid @ resid / ((c.y - c.y.mean()) ** 2).sum()
    assert res.r2 == pytest.approx(r2, rel=1e-10)
    sigma2 = resid @ resid / (len(c) - 4)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(X.T @ X)))
    np.testing.assert_allclose([res.se[v] for v in ["const", "x1", "x2", "x3"]], se, rtol=1e-8)
    assert res.n == len(c)
    # a constant regressor is dropped, the intercept kept
    res_k = ols_from_gram(g, "y", ["x1", "k"])
    assert res_k.coef["k"] == 0.0 and res_k.rank == 1


def test_vif_matches_inverse_correlation(reg):
    pdf, sdf = reg
    g = gram(sdf, ["x1", "x2", "x3"])
    got = dict(vif_from_gram(g, ["x1", "x2", "x3"]))
    c = pdf[["x1", "x2", "x3"]].dropna()
    exp = np.diag(np.linalg.inv(np.corrcoef(c.to_numpy().T)))
    np.testing.assert_allclose([got[k] for k in ["x1", "x2", "x3"]], exp, rtol=1e-9)
    assert vif_from_gram(g, ["x1"]) == [("x1", 1.0)]
    sel = select_by_vif(g, ["x1", "x2", "x3"], severe=1.5)
    assert sel["removed_features"] and sel["removed_features"][0] in ("x1", "x3")


def test_shapiro_sanity():
    rng = np.random.default_rng(0)
    w, p = shapiro_wilk(rng.normal(size=300))
    assert 0.98 < w <= 1 and p > 0.01
    w2, p2 = shapiro_wilk(rng.exponential(size=300))
    assert w2 < 0.95 and p2 < 1e-6
    # classic textbook sample (weights of 11 men): W = 0.79, strongly non-normal
    w3, p3 = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w3 == pytest.approx(0.79, abs=0.01) and p3 < 0.01

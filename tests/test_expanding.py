"""Expanding least squares from prefix sums against one refit per month; prefix quantiles against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from qualityspark.operators.expanding import expanding_linear
from qualityspark.operators.features import FeatureGroup
from qualityspark.operators.models import ModelSpec, PenalisedLinear, monthly_rolling, monthly_rolling_models, pipeline_for
from qualityspark.operators.ranks import prefix_quantiles


def _frame(spark, n=900, months=16, gaps=0.05):
    rng = np.random.default_rng(3)
    day = np.sort(rng.integers(0, 30 * months, n))
    x = rng.normal(10, 2, (n, 3))
    x[rng.random(n) < 0.04, 0] += 30                                  # outliers that are clipped, differently each year
    y = 2 + x @ np.array([1.0, -0.5, 0.2]) + 0.01 * day + rng.normal(0, 0.3, n)
    x[rng.random((n, 3)) < gaps] = np.nan
    rows = [(i, dt.datetime(2020, 1, 5) + dt.timedelta(days=int(day[i])), *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "lot_id long, date timestamp, a double, b double, c double, target double")


@pytest.fixture(scope="module")
def spec():
    return ModelSpec("linear_regression", PenalisedLinear(kind="ols", featuresCol="scaled", labelCol="label"), {}, True)


@pytest.mark.parametrize("numeric", [("a", "b", "c"), ("a", "time_trend", "log_b")])
def test_equals_one_refit_a_month(spark, spec, numeric):
    df = _frame(spark)
    group = FeatureGroup("g", numeric, (), False)
    got, refit = expanding_linear(df, group, "target", ["a", "b"])
    want = monthly_rolling_models(df, pipeline_for(group, spec, "target", ["a", "b"]), "target")
    key = ["lot_id", "test_period", "train_period_start", "train_period_end"]
    g, w = (f.toPandas().sort_values("lot_id").reset_index(drop=True) for f in (got, want))
    w = w[~w["test_period"].isin([f"{t:%Y-%m}" for t in refit])].reset_index(drop=True)
    assert len(refit) <= 1 and g[key].equals(w[key])
    assert np.allclose(g["predicted"], w["predicted"], rtol=1e-7, atol=1e-7) and np.allclose(g["actual"], w["actual"])


def test_unsafe_medians_are_refitted(spark, spec):
    """Two months far apart: the pooled median lies outside the bounds of both, so prefix sums do not hold."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        m = i * 12 // 600
        a = (0.0 if m % 2 else 100.0) + float(rng.normal())
        rows.append((i, dt.datetime(2021, 1 + m, 3), None if i % 9 == 0 else a, a * 0.1 + float(rng.normal())))
    df = spark.createDataFrame(rows, "lot_id long, date timestamp, a double, target double")
    group = FeatureGroup("g", ("a",), (), False)
    _, refit = expanding_linear(df, group, "target", ["a"])
    assert refit
    got = monthly_rolling(df, group, spec, "target", ["a"]).toPandas().sort_values("lot_id")
    want = monthly_rolling_models(df, pipeline_for(group, spec, "target", ["a"]), "target").toPandas().sort_values("lot_id")
    assert np.allclose(got["predicted"], want["predicted"], rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("max_bin", [1, 7, 2048])
def test_prefix_quantiles_by_key(spark, max_bin):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 400), "p": rng.integers(0, 12, 400), "v": np.round(rng.normal(0, 3, 400), 1)})
    sdf = spark.createDataFrame(pdf)
    targets = spark.createDataFrame([(t,) for t in (0, 1, 5, 12, 20)], "p long")
    out = prefix_quantiles(sdf, "p", "v", targets, [0.0, 0.3, 0.5, 1.0], max_bin, ["k"])
    got = out.toPandas().set_index(["k", "p", "prob"])
    seen = 0
    for (k, t, q), r in got.iterrows():
        v = pdf[(pdf.k == k) & (pdf.p < t)]["v"]
        assert r["n"] == len(v) and r["quantile"] == pytest.approx(v.quantile(q)) and r["lo"] <= r["quantile"] <= r["hi"]
        seen += 1
    assert seen == 2 * 4 * 4
    by = spark.createDataFrame([("x", 3), ("y", 9)], "k string, p long")
    some = prefix_quantiles(sdf, "p", "v", by, [0.5], max_bin, ["k"]).select("k", "p").collect()
    assert sorted(map(tuple, some)) == [("x", 3), ("y", 9)]

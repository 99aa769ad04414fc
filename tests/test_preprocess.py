"""Missing-value handling, log features, model-ready projection and the
month-wise clipper stage vs pandas brute force on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualityspark.operators.features import MonthwiseIQRClipper
from qualityspark.plans.preprocess import build_model_ready, handle_missing_values
from qualityspark.schema import QualitySchema


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 120
    date = [dt.datetime(2022, 1, 1) + dt.timedelta(days=int(d)) for d in np.sort(rng.integers(0, 300, n))]
    a = rng.normal(10, 2, n)
    a[[0, 1, 5, 6, 7, 119]] = np.nan            # leading, inner and trailing gaps
    b = np.full(n, np.nan)                       # all-missing column
    y = rng.normal(50, 5, n)
    y[[3, 4]] = np.nan
    cat = np.array([None, None] + list(rng.choice(["X", "Y"], n - 2)), dtype=object)
    cat[[10, 11, 119]] = None
    pdf = pd.DataFrame({"id": np.arange(n), "date": date, "a": a, "b": b, "y": y, "cat": cat})
    sdf = spark.createDataFrame(pdf.replace({np.nan: None}), "id long, date timestamp, a double, b double, "
                                                              "y double, cat string")
    return pdf, sdf


def test_handle_missing_values(frame):
    pdf, sdf = frame
    sch = QualitySchema(date="date", target="y", measures=("a", "b", "y"), categoricals=("cat",), tie=("id",))
    got = handle_missing_values(sdf, sch, ["a", "b", "y"], ["cat"], exclude=["y"]).toPandas() \
        .sort_values(["date", "id"]).reset_index(drop=True)
    exp = pdf.sort_values(["date", "id"]).reset_index(drop=True)
    ea = exp["a"].interpolate(method="linear", limit_direction="both")
    ea = ea.fillna(ea.median())
    np.testing.assert_allclose(got["a"].astype(float), ea, rtol=1e-12)
    assert got["b"].isna().all()                                    # all-missing stays missing
    np.testing.assert_allclose(got["y"].astype(float), exp["y"])    # target not imputed
    mode = exp["cat"].mode(dropna=True).iloc[0]
    assert list(got["cat"]) == list(exp["cat"].ffill().bfill().fillna(mode))


def test_model_ready_projection(frame, spark):
    _, sdf = frame
    df = sdf.withColumn("log_y", F.log1p("y")).withColumn("month_2", F.lit(0)).withColumn("month_3", F.lit(1))
    mr = build_model_ready(df, "y", ["a", "b", "y", "log_y"], vif_columns=["a", "b"], kept_vif=["a"],
                           categorical=["cat"])
    assert mr.columns == ["date", "y", "a", "month_2", "month_3", "cat_X", "cat_Y"]
    assert mr.where(F.col("y").isNull()).count() == 0
    with pytest.raises(ValueError):
        build_model_ready(df, "nope", [], [], [], [])


def test_clipper_learns_on_training_rows_only(frame, spark):
    pdf, sdf = frame
    df = sdf.withColumn("month", F.month("date"))
    train, test = df.where(F.col("id") < 80), df.where(F.col("id") >= 80)
    m1 = MonthwiseIQRClipper(["y"]).fit(train)
    # altering test rows must not change the fitted state (leakage test)
    m2 = MonthwiseIQRClipper(["y"]).fit(train.unionByName(test.withColumn("y", F.lit(1e9))).where(F.col("id") < 80))
    assert sorted(m1.bounds) == sorted(m2.bounds)
    out = m1.transform(test.withColumn("y", F.lit(1e9))).select("month", "y").toPandas()
    bounded = {b[1] for b in m1.bounds}
    assert (out.loc[out.month.isin(bounded), "y"] < 1e9).all()
    assert (out.loc[~out.month.isin(bounded), "y"] == 1e9).all()

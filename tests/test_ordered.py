"""Bucketed ordered scan vs a single pandas sort (brute force)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from qualityspark.operators.ordered import Ordered, mode_of


def _frame(spark, n=300, seed=1, hot_day=True):
    rng = np.random.default_rng(seed)
    days = rng.integers(0, 40, n)
    if hot_day:
        days[: n // 3] = 7                      # a third of all rows on one day
    secs = rng.integers(0, 3, n) * 3600         # few distinct times of day
    date = [dt.datetime(2024, 1, 1) + dt.timedelta(days=int(d), seconds=int(s)) for d, s in zip(days, secs)]
    y = rng.normal(50, 10, n)
    y[rng.random(n) < 0.2] = np.nan
    cat = np.where(rng.random(n) < 0.3, None, rng.choice(["A", "B", "C"], n))
    ser = rng.choice(["s1", "s2"], n)
    pdf = pd.DataFrame({"id": np.arange(n, dtype="int64"), "date": date, "y": y, "cat": cat, "ser": ser})
    sdf = spark.createDataFrame(pdf.astype({"y": "float64"}).replace({np.nan: None}),
                                "id long, date timestamp, y double, cat string, ser string")
    return pdf.sort_values(["date", "id"]).reset_index(drop=True), sdf


@pytest.mark.parametrize("max_rows", [4, 1_000_000])
def test_row_number_and_split(spark, max_rows):
    pdf, sdf = _frame(spark)
    o = Ordered(sdf, "date", ["id"], max_bucket_rows=max_rows)
    got = o.row_number("t").select("id", "t").toPandas().set_index("id")["t"]
    exp = pd.Series(np.arange(1, len(pdf) + 1), index=pdf["id"])
    assert (got.sort_index() == exp.sort_index()).all()
    sp = o.blocked_split(0.8).select("id", "split").toPandas().set_index("id")["split"]
    cut = int(len(pdf) * 0.8)
    assert set(sp[pdf["id"][:cut]]) == {"train"} and set(sp[pdf["id"][cut:]]) == {"test"}


def test_hot_day_is_split(spark):
    _, sdf = _frame(spark)
    bt = Ordered(sdf, "date", ["id"], max_bucket_rows=4).buckets().toPandas()
    assert bt["_bn"].max() <= 4           # the 100-row day is cut into small buckets
    assert bt["_bn"].sum() == 300


@pytest.mark.parametrize("tie", ["id", "name"])
def test_buckets_bounded_mixed_timestamps_and_string_ties(spark, tie):
    """1,000 rows at midnight plus 20 timed ones; numeric and string tie columns."""
    sdf = spark.range(1020).selectExpr(
        "id", "concat('n', id) AS name",
        "timestamp'2024-03-01' + make_dt_interval(0, 0, 0, CASE WHEN id < 1000 THEN 0 ELSE id * 60 END) AS date")
    bt = Ordered(sdf, "date", [tie], max_bucket_rows=100).buckets().toPandas()
    assert bt["_bn"].max() <= 100 and bt["_bn"].sum() == 1020


def test_nan_is_missing(spark):
    rows = [(0, 1.0), (1, float("nan")), (2, None), (3, 4.0)]
    sdf = spark.createDataFrame(rows, "pos long, y double")
    got = Ordered(sdf, None, ["pos"]).interpolate(["y"]).orderBy("pos").toPandas()["y"]
    assert list(got) == [1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("max_rows", [3, 1_000_000])
def test_interpolate_and_fill(spark, max_rows):
    pdf, sdf = _frame(spark)
    o = Ordered(sdf, "date", ["id"], max_bucket_rows=max_rows)
    got = o.interpolate(["y"]).select("id", "y").toPandas().set_index("id")["y"]
    # pandas interpolates by position on the sorted frame
    exp = pd.Series(pdf["y"].interpolate(method="linear", limit_direction="both").values, index=pdf["id"])
    np.testing.assert_allclose(got.sort_index().values, exp.sort_index().values, rtol=1e-12)
    mode = pdf["cat"].mode(dropna=True).iloc[0]
    o2 = Ordered(sdf.crossJoin(mode_of(sdf, "cat")), "date", ["id"], max_bucket_rows=max_rows)
    got2 = o2.fill_forward_backward(["cat"], {"cat": F.col("cat_mode")})
    got2 = got2.select("id", "cat").toPandas().set_index("id")["cat"].sort_index()
    exp2 = pd.Series(pdf["cat"].ffill().bfill().fillna(mode).values, index=pdf["id"]).sort_index()
    assert (got2 == exp2).all()


@pytest.mark.parametrize("max_rows", [3, 1_000_000])
def test_lag_roll_per_series(spark, max_rows):
    pdf, sdf = _frame(spark)
    o = Ordered(sdf, "date", ["id"], ["ser"], max_bucket_rows=max_rows)
    got = o.lag_features("y").select("id", "y_lag1", "y_roll3", "date_diff_days").toPandas().set_index("id").sort_index()
    parts = []
    for _, g in pdf.groupby("ser"):
        g = g.sort_values(["date", "id"]).copy()
        lag1 = g["y"].shift(1)
        dd = g["date"].diff().dt.days
        lag1[dd.gt(2)] = np.nan
        g["y_lag1"] = lag1
        g["y_roll3"] = lag1.rolling(3, min_periods=2).mean()
        g["date_diff_days"] = dd
        parts.append(g)
    exp = pd.concat(parts).set_index("id").sort_index()
    np.testing.assert_allclose(got["y_lag1"].astype(float), exp["y_lag1"], rtol=1e-12)
    np.testing.assert_allclose(got["y_roll3"].astype(float), exp["y_roll3"], rtol=1e-12)
    np.testing.assert_allclose(got["date_diff_days"].astype(float), exp["date_diff_days"])


def test_acf_matches_numpy(spark):
    pdf, sdf = _frame(spark, hot_day=False)
    o = Ordered(sdf, "date", ["id"], max_bucket_rows=5)
    got = o.acf("y", 10).toPandas().sort_values("lag")
    x = pdf["y"].dropna().values
    d = x - x.mean()
    c0 = (d * d).sum()
    exp = [(d[: len(d) - k] * d[k:]).sum() / c0 for k in range(11)]
    np.testing.assert_allclose(got["acf"].values, exp, rtol=1e-10, atol=1e-12)
    var = np.ones(11) / len(x)
    var[0] = 0
    var[2:] *= 1 + 2 * np.cumsum(np.array(exp[1:-1]) ** 2)
    np.testing.assert_allclose(got["se"].values, np.sqrt(var), rtol=1e-10)


@pytest.mark.parametrize("max_rows", [7, 1_000_000])
def test_lag_without_date_uses_order_column(spark, max_rows):
    """Plain lag-1 in file order when there is no date column."""
    rng = np.random.default_rng(8)
    pos = rng.permutation(200)
    y = rng.normal(size=200)
    sdf = spark.createDataFrame(pd.DataFrame({"row_pos": pos.astype("int64"), "y": y}))
    got = Ordered(sdf, None, ["row_pos"], max_bucket_rows=max_rows).lag_features("y") \
        .select("row_pos", "y_lag1").toPandas().set_index("row_pos").sort_index()
    exp = pd.Series(y, index=pos).sort_index().shift(1)
    np.testing.assert_allclose(got["y_lag1"].astype(float), exp.values)


def test_fill_frames_only_grow_and_time_is_linear(spark):
    """No row-level frame ends in unbounded following, and twice the rows in one bucket
    do not take four times as long."""
    import time

    def frame(n):
        return spark.range(n).selectExpr("id", "timestamp'2024-01-01' + make_dt_interval(0, 0, id) AS date",
                                         "CASE WHEN id % 3 = 0 THEN cast(id AS double) END AS y", "CASE WHEN id % 4 = 1 THEN 'a' END AS c")

    def run(n):
        t = time.time()
        o = Ordered(frame(n), "date", ["id"], max_bucket_rows=1_000_000)
        out = o.interpolate(["y"])
        assert out.agg(F.sum("y")).first()[0] > 0
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        return time.time() - t

    run(2_000)
    assert run(60_000) < 4 * max(run(30_000), 2.0)


@pytest.mark.parametrize("max_rows", [3, 1_000_000])
def test_carry_over_empty_buckets_and_partitions(spark, max_rows):
    """Long runs of missing values cross buckets and range partitions, per series."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(400), "y": np.where(rng.random(400) < 0.02, rng.normal(size=400), np.nan), "s": np.arange(400) % 2})
    pdf.loc[150:320, "y"] = np.nan
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, y double, s long").repartition(7)
    got = Ordered(sdf, None, ["id"], ["s"], max_bucket_rows=max_rows).interpolate(["y"]).select("id", "y").toPandas().set_index("id")["y"]
    want = pd.concat([g.set_index("id")["y"].interpolate(limit_direction="both") for _, g in pdf.groupby("s")]).sort_index()
    assert np.allclose(got.sort_index(), want)

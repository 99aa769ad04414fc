"""Alert metrics and prefix quantiles vs numpy brute force (edge fixtures:
no positives, no alerts, n = 1, tied scores, NULL / NaN scores)."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from qualityspark.operators.ranks import prefix_quantiles
from qualityspark.operators.risk import TOP_K_FRACTIONS, alert_metrics


def _brute(actual, score, ids, t):
    ok = np.isfinite(actual) & np.isfinite(score)
    a, s, i = actual[ok], score[ok], ids[ok]
    hi_a, hi_p = a >= t, s >= t
    tp = int(np.sum(hi_a & hi_p)); fp = int(np.sum(~hi_a & hi_p))
    tn = int(np.sum(~hi_a & ~hi_p)); fn = int(np.sum(hi_a & ~hi_p))
    pos = tp + fn
    out = {"n_samples": len(a), "true_positive": tp, "false_positive": fp, "true_negative": tn,
           "false_negative": fn, "precision": tp / (tp + fp) if tp + fp else 0.0,
           "recall": tp / pos if pos else None}
    order = np.lexsort((i, -s))                 # score desc, id asc
    for f in TOP_K_FRACTIONS:
        k = max(1, math.ceil(len(a) * f))
        hits = int(np.sum(hi_a[order[:k]]))
        out[f"top_{int(round(f * 100))}pct_precision"] = hits / k
        out[f"top_{int(round(f * 100))}pct_recall"] = hits / pos if pos else None
    return out


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(9)
    rows = []
    for slice_id, n in [("big", 300), ("ties", 50), ("one", 1), ("low", 40)]:
        a = rng.normal(10, 3, n)
        s = a + rng.normal(0, 2, n)
        if slice_id == "ties":
            s = np.round(s / 4) * 4                    # heavy ties
        if slice_id == "low":
            a = a - 100                                # no positives
            s = s - 100                                # no alerts
        s[:2] = np.nan if n > 2 else s[:2]
        for j in range(n):
            rows.append((slice_id, int(j * 7 % 101 + 1000 * (slice_id == "big")), float(a[j]),
                         None if np.isnan(s[j]) else float(s[j])))
    pdf = pd.DataFrame(rows, columns=["sl", "lot_id", "actual", "predicted"])
    return pdf, spark.createDataFrame(pdf, "sl string, lot_id long, actual double, predicted double")


def test_alert_metrics_brute_force(spark, preds):
    pdf, sdf = preds
    th = spark.createDataFrame([("p75", 0.75, 11.0), ("p80", 0.8, 12.5), ("p90", 0.9, 14.0)],
                               "threshold_name string, quantile double, threshold_ppm double")
    got = alert_metrics(sdf, th, ["sl"]).toPandas()
    for (sl, tn), row in got.set_index(["sl", "threshold_name"]).iterrows():
        part = pdf[pdf.sl == sl]
        t = {"p75": 11.0, "p80": 12.5, "p90": 14.0}[tn]
        exp = _brute(part.actual.to_numpy(), part.predicted.astype(float).to_numpy(), part.lot_id.to_numpy(), t)
        for k, v in exp.items():
            if v is None:
                assert row[k] is None or (isinstance(row[k], float) and math.isnan(row[k])), (sl, tn, k)
            else:
                assert row[k] == pytest.approx(round(v, 6) if isinstance(v, float) else v), (sl, tn, k)


@pytest.mark.parametrize("max_bin", [4, 2048])
def test_prefix_quantiles(spark, max_bin):
    rng = np.random.default_rng(4)
    n = 400
    months = rng.integers(0, 8, n)
    vals = np.round(rng.gamma(2, 3, n), 1)
    pdf = pd.DataFrame({"p": [dt.datetime(2020, 1 + int(m), 1) for m in months], "v": vals})
    sdf = spark.createDataFrame(pdf, "p timestamp, v double")
    tg = sdf.select("p").distinct()
    got = prefix_quantiles(sdf, "p", "v", tg, [0.5, 0.9], max_bin=max_bin).toPandas()
    for _, r in got.iterrows():
        prior = pdf[pdf.p < r["p"]].v
        assert r["n"] == len(prior)
        assert r["quantile"] == pytest.approx(prior.quantile(r["prob"]), rel=1e-12)
    # the first month has no earlier rows: no quantile row
    assert pdf.p.min() not in set(got.p)


def test_alert_metrics_small_tie_bins(spark, preds, monkeypatch):
    """Same brute-force check with tiny id bins, so tied rows span many bins."""
    from qualityspark.operators import risk
    monkeypatch.setattr(risk, "TIE_BIN", 3)
    test_alert_metrics_brute_force(spark, preds)


def _sliced(spark):
    """Two sources, constants of three slices on each, and a scored slice on one."""
    from qualityspark.operators.validation import Sliced
    rng = np.random.default_rng(21)
    rows = []
    for year, n in [(1, 120), (2, 33)]:
        a = np.round(rng.normal(11, 3, n), 1)
        rows += [(year, "constant", int(i * 37 % 997), float(v), None) for i, v in enumerate(a)]
        rows += [(year, "previous_value", int(i * 37 % 997), float(v), float(np.round(v + rng.normal(0, 2))))
                 for i, v in enumerate(a) if i % 3]
    sources = spark.createDataFrame(rows, "test_year int, scorer string, lot_id long, actual double, predicted double")
    consts = [(7, y, "mean", "constant", v) for y in (1, 2) for v in (12.5,)]
    consts += [(8, y, "median", "constant", v) for y in (1, 2) for v in (9.0,)]
    consts += [(9, 1, "mean", "constant", 30.0), (9, 2, "mean", "constant", math.nan), (7, 1, "previous_value", "previous_value", None)]
    slices = spark.createDataFrame(consts, "train_year int, test_year int, model string, scorer string, value double")
    return Sliced(sources, slices, ["test_year", "scorer"]), pd.DataFrame(rows, columns=sources.columns), consts


def test_sliced_alerts_equal_row_alerts(spark):
    """Counts by source equal the metrics over the expanded fact table and brute force."""
    from qualityspark.operators.risk import sliced_alert_metrics
    sliced, _, _ = _sliced(spark)
    th = spark.createDataFrame([("p75", 0.75, 11.0), ("p80", 0.8, 12.5), ("p90", 0.9, 14.0)],
                               "threshold_name string, quantile double, threshold_ppm double")
    keys = ["train_year", "test_year", "model"]
    got = sliced_alert_metrics(sliced, th, keys).toPandas()
    want = alert_metrics(sliced.rows(), th, keys).toPandas()
    order = keys + ["threshold_name"]
    assert len(got) == 3 * 6                         # the NaN constant gives no rows
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True),
                                  want.sort_values(order).reset_index(drop=True)[got.columns], check_dtype=False)


def test_constant_metrics_brute_force(spark):
    """R2, RMSE and MAE of constants from cell counts; a constant target; a slice without rows."""
    from qualityspark.operators.validation import constant_metrics
    rng = np.random.default_rng(5)
    y = {1: np.round(rng.normal(1e5, 3, 400), 2), 2: np.full(7, 0.1), 3: np.array([4.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, a in y.items() for v in a] + [(1, None)], "src int, y double")
    consts = [(k, m, v) for k in (1, 2, 3, 4) for m, v in (("a", 0.1), ("b", 1e5), ("c", float(y[1][0])), ("d", 4.0))]
    got = constant_metrics(rows, ["src"], spark.createDataFrame(consts, "src int, m string, value double"), "y").toPandas()
    assert set(got.src) == {1, 2, 3} and len(got) == 12
    for r in got.itertuples():
        a, c = y[r.src], r.value
        sse, sst = float(((a - c) ** 2).sum()), float(((a - a.mean()) ** 2).sum())
        flat = a.min() == a.max()
        r2 = (1.0 if (a == c).all() else 0.0) if flat else 1 - sse / sst
        assert r.n == len(a) and r.r2 == pytest.approx(r2, rel=1e-9, abs=1e-6)
        assert r.rmse == pytest.approx(math.sqrt(sse / len(a)), rel=1e-9, abs=1e-6)
        assert r.mae == pytest.approx(float(np.abs(a - c).mean()), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_values_of_ranks(spark, kind):
    """Ranks that differ by group, in groups that are bracketed and groups that are not; close ids beyond 2**53."""
    from qualityspark.operators.ranks import values_of_ranks
    rng = np.random.default_rng(3)
    groups = {1: np.round(rng.normal(0, 50, 12000), 1), 2: np.array([4.0]), None: np.repeat([1.0, 2.0], [9000, 5])}
    if kind == "long":
        groups = {k: a.astype(np.int64) + 2 ** 60 for k, a in groups.items()}
    groups = {k: a.tolist() for k, a in groups.items()}
    sdf = spark.createDataFrame([(k, v) for k, a in groups.items() for v in [*a, None]], f"g int, v {kind}")
    ranks = {1: [0, 1, 9, 3000, 7777, 11999, 12000], 2: [0, 1], None: [-1, 8999, 9000]}
    tg = spark.createDataFrame([(k, r) for k, rs in ranks.items() for r in rs], "g int, _r long")
    got = {(r.g, r._r): r.v for r in values_of_ranks(sdf, ["g"], "v", tg, accuracy=2000).collect()}
    assert got == {(k, r): sorted(groups[k])[r] for k, rs in ranks.items() for r in rs if 0 <= r < len(groups[k])}


def test_top_k_places_no_rows(spark, preds, monkeypatch):
    """Scores and tied ids are not put in order as a whole; NULL ids come first."""
    from qualityspark.operators import ranks

    def no_place(*_, **__):
        raise AssertionError("rows were placed in total order")

    monkeypatch.setattr(ranks, "place", no_place)
    test_alert_metrics_brute_force(spark, preds)
    rows = [("a", None, 20.0, 1.0), ("a", 1, 1.0, 1.0), ("a", 2, 20.0, 1.0), ("a", 2, 20.0, 1.0)]
    th = spark.createDataFrame([("p75", 0.75, 11.0)], "threshold_name string, quantile double, threshold_ppm double")
    got = alert_metrics(spark.createDataFrame(rows, "sl string, lot_id long, actual double, predicted double"), th, ["sl"],
                        qs=[0.75], fractions=[0.25, 0.5, 0.75]).first()
    assert (got.top_25pct_precision, got.top_50pct_precision, got.top_75pct_recall) == (1.0, 0.5, 1.0)


def test_alert_metrics_ids_that_are_no_numbers(spark, preds):
    pdf, sdf = preds
    th = spark.createDataFrame([("p75", 0.75, 11.0)], "threshold_name string, quantile double, threshold_ppm double")
    text = sdf.withColumn("lot_id", sdf.lot_id.cast("decimal(20,0)"))
    one, two = (alert_metrics(d, th, ["sl"], qs=[0.75]).toPandas().sort_values("sl").reset_index(drop=True) for d in (sdf, text))
    pd.testing.assert_frame_equal(one, two)

"""Steps that several queries share do their work once: rank input, placement, year models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def test_spearman_holds_a_row_and_feature_once(spark, monkeypatch):
    from qualityspark.operators import correlation
    rng = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n), "c": rng.integers(0, 50, n).astype(float),
                        "d": rng.normal(size=n)})
    pdf["e"] = pdf.a + rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.3, "c"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "d"] = np.nan
    pdf.loc[:3, ["a", "b", "c", "d", "e"]] = np.nan                   # no value at all
    sizes, whole = [], correlation.to_long
    monkeypatch.setattr(correlation, "to_long", lambda *x, **y: sizes.append(whole(*x, **y)) or sizes[-1])
    sdf = spark.createDataFrame([[None if pd.isna(v) and i % 2 else float(v) for v in r] for i, r in enumerate(pdf.values)],
                                "a double, b double, c double, d double, e double")
    got = {(r[0], r[1]): r[2] for r in correlation.spearman_matrix(sdf, list("abcde")).collect()}
    want = pdf.corr(method="spearman")
    assert len(got) == 25 and all(got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9) for x, y in got)
    assert sum(f.count() for f in sizes) <= 5 * n                     # not once more per null signature


def test_missing_values_place_the_rows_once(spark, monkeypatch):
    from qualityspark.operators import ordered
    from qualityspark.plans.preprocess import handle_missing_values
    from qualityspark.schema import QualitySchema
    n = 60
    x = [None if i % 4 == 1 else float(i * i) for i in range(n)]
    k = [None if i < 3 or i % 5 == 0 else "ab"[i % 2] for i in range(n)]
    rows = [(i, dt.datetime(2021, 1, 1) + dt.timedelta(days=i), x[i], None, k[i], None) for i in range(n)]
    df = spark.createDataFrame(rows[::-1], "id long, date timestamp, x double, z double, k string, u string")
    calls, place = [], ordered.place
    monkeypatch.setattr(ordered, "place", lambda *a, **b: calls.append(1) or place(*a, **b))
    schema = QualitySchema(date="date", target="y", measures=("x", "z"), categoricals=("k", "u"), tie=("id",))
    out = handle_missing_values(df, schema, ["x", "z"], ["k", "u"]).toPandas().sort_values("id")
    assert out.x.tolist() == pytest.approx(pd.Series(x, dtype=float).interpolate(limit_direction="both").tolist())
    assert out.k.tolist() == pd.Series(k).ffill().bfill().tolist()
    assert out.z.isna().all() and (out.u == "UNKNOWN").all() and list(out.columns) == df.columns
    assert len(calls) == 1


def test_year_models_share_what_columns_learn(spark, monkeypatch):
    from qualityspark.operators import features, models
    rng = np.random.default_rng(8)
    n = 240
    rows = [(i, dt.datetime(2020 + i % 3, 1 + i % 12, 1 + i % 28), 2020 + i % 3, None if i % 9 == 0 else float(a), float(b),
             None if i % 10 == 0 else "xyz"[i % 3], float(2 * a + b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(n, 3)))]
    df = spark.createDataFrame(rows, "lot_id long, date timestamp, year int, a double, b double, tank string, target double")
    groups = [features.FeatureGroup("one", ("a",), (), False), features.FeatureGroup("two", ("a", "b", "time_trend"), ("tank",), True)]
    spec = {s.name: s for s in models.model_specs()}["linear_regression"]
    key = ["train_year", "test_year"]
    want = {g.name: models.year_holdout_models(df, models.pipeline_for(g, spec, "target", ["a"]), "target")[0].orderBy(*key).toPandas()
            for g in groups}
    fits, fit = [], features.ExactImputer._fit
    monkeypatch.setattr(features.ExactImputer, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    got = models.year_holdout_all(df, [(g, spec, {}) for g in groups], "target", ["a"]).toPandas()
    assert len(fits) == 3                                             # years, not years x configurations
    for g in groups:
        mine = got[got.feature_group == g.name].sort_values(key)
        for c in want[g.name].columns:
            assert mine[c].tolist() == pytest.approx(want[g.name][c].tolist(), abs=2e-6)
    again = models.year_holdout_all(df, [(groups[0], spec, {})], "target", ["a"], done={("one", spec.name): df.select("lot_id")},
                                    store=object())
    assert again.columns == ["lot_id", "feature_group", "model"] and len(fits) == 3

"""End to end on the plant layout: monthly files -> ingest -> preprocess
(breakpoint, time features, clip, impute, log, diagnostics, VIF, model-ready)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualityspark.plans.preprocess import run_preprocess
from qualityspark.schema import (BOXPLOT_COLUMNS, IQR_COLUMNS, LOG_COLUMNS, PLANT, RAW_COLUMNS,
                                 TRANSITION_BASE_COLUMNS, VIF_COLUMNS)
from qualityspark.sources.monthly import load_raw_inputs


def _write_month(path, year, month, rng):
    lines = ["title,,", "plant A,,", ",,", "hdr," + ",".join(RAW_COLUMNS)]
    day = dt.date(year, month, 1)
    while day.month == month:
        vals = {c: f"{rng.normal(10, 2):.3f}" for c in RAW_COLUMNS}
        vals["date"] = day.isoformat()
        vals["feed_p_ppm"] = f"{rng.normal(20, 4) + (8 if month >= 10 else 0):.2f}"
        vals["feed_tank"] = rng.choice([" t1 ", "T2", "nan", ""])
        vals["feed_type"] = rng.choice(["A", "b"])
        vals["rbd_tank"], vals["rbd_type"] = "R1", "X"
        if rng.random() < 0.1:
            vals["feed_dobi"] = "STOP"
        lines.append("x," + ",".join(vals[c] for c in RAW_COLUMNS))
        day += dt.timedelta(days=1)
    (path / f"{year}_{month:02d}.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def plant_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("plant")
    rng = np.random.default_rng(21)
    for m in [6, 7, 8, 10, 11, 12]:            # no September: transition candidate year
        _write_month(d, 2023, m, rng)
    for m in [1, 2, 3]:
        _write_month(d, 2024, m, rng)
    return d


def test_plant_preprocess(spark, plant_dir):
    typed, meta = load_raw_inputs(spark, [str(plant_dir)])
    assert meta.first()["years_present"] == "2023,2024"
    corr = ["feed_dobi", "feed_ffa_pct", "feed_mi_pct", "feed_iv", "feed_car_pv", "feed_p_ppm", "rbd_p_ppm"]
    out = run_preprocess(
        typed, PLANT, iqr_columns=IQR_COLUMNS, transition_columns=TRANSITION_BASE_COLUMNS,
        corr_columns=corr, vif_columns=VIF_COLUMNS,
        base_features=["acid_dosing_pct", "bleaching_earth_dosing_pct", "feed_ffa_pct", "feed_mi_pct", "feed_iv",
                       "feed_dobi", "feed_car_pv", "feed_p_ppm", "log_feed_ffa_pct", "log_feed_p_ppm",
                       "time_trend", "missing_transition_phase"],
        log_columns=LOG_COLUMNS, boxplot_columns=BOXPLOT_COLUMNS)
    full = out["processed_full"]
    n = typed.count()
    assert full.count() == n
    # numerics other than the target are fully imputed, categoricals too
    assert full.where(F.col("feed_dobi").isNull() | F.col("feed_tank").isNull()).count() == 0
    assert full.agg(F.max("time_trend")).first()[0] == n
    mr = out["model_ready"]
    assert "feed_p_ppm" in mr.columns and "log_feed_p_ppm" not in mr.columns     # leakage guard
    assert {"month_2", "month_12"} <= set(mr.columns) and "month_1" not in mr.columns
    assert any(c.startswith("feed_tank_") for c in mr.columns)
    assert out["vif_selection"]["kept_features"]
    rep = {r["year"]: r for r in out["transition_report"].collect()}
    assert rep[2023]["has_missing_sep"] and rep[2023]["jump_detected"]
    assert rep[2023]["apply_transition_dummy"]
    flagged = full.where("missing_transition_phase = 1").select(F.month("date").alias("m")).distinct()
    assert sorted(r["m"] for r in flagged.collect()) == [10, 11, 12]
    assert out["summary"].first()["rows_after"] == n
    assert out["descriptive"].count() > 0 and out["monthly_boxplot"].count() > 0

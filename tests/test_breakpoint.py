"""Transition breakpoint: window choice, Welch statistics, jump rule, flag."""

import datetime as dt
import math

import numpy as np
import pytest

from qualityspark.operators.breakpoint import apply_transition_flag, breakpoint_stats, transition_report
from qualityspark.operators.tails import t_sf2


def _rows():
    rows, rid = [], 0
    rng = np.random.default_rng(5)

    def add(y, m, d, v):
        nonlocal rid
        rows.append((rid, dt.datetime(y, m, d), float(v)))
        rid += 1
    # 2020: Aug + Oct, no Sep, narrow windows have >= 6 rows, clear jump
    for d in range(22, 32):
        add(2020, 7, d, 10 + rng.normal(0, .5))
    for d in range(1, 16):
        add(2020, 8, d, 10 + rng.normal(0, .5))
    for d in range(1, 11):
        add(2020, 10, d, 20 + rng.normal(0, .5))
    add(2020, 11, 1, 20)
    # 2021: has September -> no dummy even with a jump; sparse windows -> whole months
    for d in (2, 20, 25):
        add(2021, 8, d, 5)
    add(2021, 9, 1, 5)
    for d in (3, 15, 28):
        add(2021, 10, d, 9)
    # 2022: no October -> not tested
    add(2022, 8, 1, 1)
    return rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(_rows(), "id long, date timestamp, x double")


def test_stats_and_jump(df):
    st = {r["year"]: r for r in breakpoint_stats(df, ["x"]).collect()}
    assert set(st) == {2020, 2021}
    r = st[2020]
    assert r["pre_n"] == 25 and r["post_n"] == 10
    pre = [v for _, d, v in _rows() if d.year == 2020 and ((d.month == 7 and d.day >= 22) or (d.month == 8 and d.day <= 15))]
    post = [v for _, d, v in _rows() if d.year == 2020 and d.month == 10 and d.day <= 10]
    v1, v2 = np.var(pre, ddof=1), np.var(post, ddof=1)
    t = (np.mean(pre) - np.mean(post)) / math.sqrt(v1 / 25 + v2 / 10)
    dfw = (v1 / 25 + v2 / 10) ** 2 / ((v1 / 25) ** 2 / 24 + (v2 / 10) ** 2 / 9)
    assert r["t_stat"] == pytest.approx(t, rel=1e-10) and r["welch_df"] == pytest.approx(dfw, rel=1e-10)
    assert r["ttest_pvalue"] == pytest.approx(t_sf2(t, dfw)) and r["jump_flag"]
    r21 = st[2021]
    assert r21["pre_n"] == 3 and r21["post_n"] == 3            # whole-month fallback
    assert r21["t_stat"] is None and r21["effect_size_like"] == math.inf and r21["jump_flag"]


def test_report_and_flag(df):
    rep = {r["year"]: r for r in transition_report(df, ["x"]).collect()}
    assert rep[2020]["apply_transition_dummy"] and not rep[2021]["apply_transition_dummy"]
    assert rep[2021]["jump_detected"] and not rep[2022]["jump_detected"]
    flagged = apply_transition_flag(df, transition_report(df, ["x"])).where("missing_transition_phase = 1")
    assert sorted(r["date"].month for r in flagged.collect()) == [10] * 10 + [11]


def test_t_two_sided_column(spark):
    """The p-value expression against the continued fraction, and its edges."""
    from pyspark.sql import functions as F

    from qualityspark.functions.numeric import t_two_sided
    from qualityspark.operators.tails import norm_sf, t_sf2
    cases = [(t, d) for t in (0.0, 0.3, -1.7, 2.6, 5.0, -12.0, 40.0) for d in (1.0, 2.5, 7.0, 14.3, 120.0, 5e4)]
    near_normal = [(t, 1e7) for t in (0.3, -1.7, 5.0)]          # lgamma loses digits there
    edges = [(float("inf"), 9.0), (None, 3.0), (float("nan"), 3.0), (1.0, None), (1.0, 0.0)]
    df = spark.createDataFrame(list(enumerate(cases + edges + near_normal)), "i int, c struct<t:double,d:double>")
    got = [r[0] for r in df.orderBy("i").select(t_two_sided(F.col("c.t"), F.col("c.d"))).collect()]
    for (t, d), p in zip(cases, got):
        assert p == pytest.approx(t_sf2(t, d), rel=1e-8, abs=1e-12), (t, d)
    assert got[len(cases):-3] == [0.0, None, None, None, None]
    assert got[-3:] == pytest.approx([2 * norm_sf(abs(t)) for t, _ in near_normal], rel=1e-4)

"""Yearly transition-breakpoint test and transition flag.

Per year: does it have August / September / October rows; a pre window
(22 Jul - 15 Aug, else all of August when it has fewer than 6 rows) and a post
window (1-10 Oct, else all of October).  Per (year, feature) on non-null
values: means, relative change, an effect size against the mean of the two
sample standard deviations and a Welch t-test (both sides >= 8 values).  A
jump needs a relative change >= 0.2 and either effect >= 1 or p < 0.01; the
transition dummy applies to jump years that have no September.

One grouped aggregate per level (year table, then year x feature); the
p-value is a column expression over the years x features result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.functions.numeric import t_two_sided
from qualityspark.operators.outliers import to_long

EFFECT_THRESHOLD = 1.0
REL_CHANGE_THRESHOLD = 0.2
P_THRESHOLD = 0.01


def year_windows(df: DataFrame, date_col: str = "date") -> DataFrame:
    """One row per year with month flags and window choice."""
    d = F.col(date_col)
    m, dd = F.month(d), F.dayofmonth(d)
    pre_n = ((m == 7) & (dd >= 22)) | ((m == 8) & (dd <= 15))
    post_n = (m == 10) & (dd <= 10)
    y = df.groupBy(F.year(d).alias("year")).agg(
        F.array_sort(F.collect_set(m)).alias("months_present"),
        F.max((m == 8).cast("int")).alias("_aug"), F.max((m == 9).cast("int")).alias("_sep"),
        F.max((m == 10).cast("int")).alias("_oct"),
        F.count_if(pre_n).alias("_npre"), F.count_if(post_n).alias("_npost"),
        F.count_if(m == 8).alias("_naug"), F.count_if(m == 10).alias("_noct"))
    both = (F.col("_aug") == 1) & (F.col("_oct") == 1)
    return y.select(
        "year", "months_present", (F.col("_aug") == 1).alias("has_aug"), (F.col("_sep") == 1).alias("has_sep"),
        (F.col("_oct") == 1).alias("has_oct"), (F.col("_sep") == 0).alias("has_missing_sep"),
        (F.col("_npre") < 6).alias("_wide_pre"), (F.col("_npost") < 6).alias("_wide_post"),
        F.when(both, F.when(F.col("_npre") < 6, F.col("_naug")).otherwise(F.col("_npre"))).otherwise(0)
        .cast("long").alias("pre_window_rows"),
        F.when(both, F.when(F.col("_npost") < 6, F.col("_noct")).otherwise(F.col("_npost"))).otherwise(0)
        .cast("long").alias("post_window_rows"),
        both.alias("_tested"))


def breakpoint_stats(df: DataFrame, columns, date_col: str = "date", with_p: bool = True) -> DataFrame:
    """O3: one row per (tested year, feature)."""
    yw = year_windows(df, date_col)
    d = F.col(date_col)
    m, dd = F.month(d), F.dayofmonth(d)
    # the year table has one row per calendar year: safe to broadcast
    rows = df.withColumn("year", F.year(d)).join(F.broadcast(yw.where("_tested")), "year")
    in_pre = F.when(F.col("_wide_pre"), m == 8).otherwise(((m == 7) & (dd >= 22)) | ((m == 8) & (dd <= 15)))
    in_post = F.when(F.col("_wide_post"), m == 10).otherwise((m == 10) & (dd <= 10))
    side = F.when(in_pre, F.lit("pre")).when(in_post, F.lit("post"))
    w = rows.withColumn("_side", side).where(F.col("_side").isNotNull())
    long = to_long(w, columns, ids=["year", "_side"])
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v)
    pre, post = ok & (F.col("_side") == "pre"), ok & (F.col("_side") == "post")
    st = long.groupBy("year", "feature").agg(
        F.count_if(pre).alias("pre_n"), F.count_if(post).alias("post_n"),
        F.avg(F.when(pre, v)).alias("_m1"), F.avg(F.when(post, v)).alias("_m2"),
        F.var_samp(F.when(pre, v)).alias("_v1"), F.var_samp(F.when(post, v)).alias("_v2"))
    # features with no window rows at all still get a row
    feats = yw.where("_tested").select("year").crossJoin(
        F.broadcast(df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")))
    st = feats.join(st, ["year", "feature"], "left").fillna(0, subset=["pre_n", "post_n"])
    tested = (F.col("pre_n") >= 3) & (F.col("post_n") >= 3)
    diff = F.col("_m2") - F.col("_m1")
    rel = F.abs(diff) / (F.abs(F.col("_m1")) + F.lit(1e-9))
    pooled = (F.sqrt("_v1") + F.sqrt("_v2")) / 2
    effect = (F.when(pooled > 0, F.abs(diff) / pooled)
              .when(diff != 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    se2 = F.col("_v1") / F.col("pre_n") + F.col("_v2") / F.col("post_n")
    big = (F.col("pre_n") >= 8) & (F.col("post_n") >= 8)
    t = F.when(se2 > 0, (F.col("_m1") - F.col("_m2")) / F.sqrt(se2)) \
        .when(diff != 0, F.when(diff < 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    dfw = F.when(se2 > 0, se2 * se2 / ((F.col("_v1") / F.col("pre_n")) ** 2 / (F.col("pre_n") - 1)
                                      + (F.col("_v2") / F.col("post_n")) ** 2 / (F.col("post_n") - 1)))
    out = st.select(
        "year", "feature", F.col("pre_n").cast("long"), F.col("post_n").cast("long"),
        F.when(tested, F.col("_m1")).alias("pre_mean"), F.when(tested, F.col("_m2")).alias("post_mean"),
        F.when(tested, diff).alias("mean_diff_post_minus_pre"),
        F.when(tested, rel).alias("relative_change"), F.when(tested, effect).alias("effect_size_like"),
        F.when(tested & big, t).alias("t_stat"),
        F.when(tested & big, F.coalesce(dfw, F.col("pre_n") + F.col("post_n") - 2.0)).alias("welch_df"))
    if with_p:
        out = out.withColumn("ttest_pvalue", t_two_sided(F.col("t_stat"), F.col("welch_df")))
        p_rule = F.coalesce(F.col("ttest_pvalue") < P_THRESHOLD, F.lit(False))
    else:
        p_rule = F.lit(False)
    rel_ok = F.col("relative_change") >= REL_CHANGE_THRESHOLD
    jump = F.coalesce(rel_ok & ((F.col("effect_size_like") >= EFFECT_THRESHOLD) | p_rule), F.lit(False))
    return out.withColumn("jump_flag", jump)


def transition_report(df: DataFrame, columns, date_col: str = "date") -> DataFrame:
    """O3 year level: month flags, window rows, jump_detected, apply_transition_dummy."""
    yw = year_windows(df, date_col)
    st = breakpoint_stats(df, columns, date_col)
    jumps = st.groupBy("year").agg(F.max(F.col("jump_flag").cast("int")).alias("_j"))
    r = yw.join(jumps, "year", "left")
    jd = F.coalesce(F.col("_j") == 1, F.lit(False))
    return r.select("year", "months_present", "has_aug", "has_sep", "has_oct", "has_missing_sep",
                    "pre_window_rows", "post_window_rows", jd.alias("jump_detected"),
                    (F.col("has_missing_sep") & jd).alias("apply_transition_dummy"))


def apply_transition_flag(df: DataFrame, report: DataFrame, date_col: str = "date",
                          name: str = "missing_transition_phase") -> DataFrame:
    """1 for rows of dummy years from October on.  The jump-year table has
    one row per year: broadcast."""
    jy = report.where("apply_transition_dummy").select(F.col("year").alias("_jy"))
    j = df.join(F.broadcast(jy), F.year(F.col(date_col)) == F.col("_jy"), "left")
    flag = (F.col("_jy").isNotNull() & (F.month(F.col(date_col)) >= 10)).cast("int")
    return j.withColumn(name, flag).drop("_jy")

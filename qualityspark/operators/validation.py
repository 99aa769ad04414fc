"""Split designs, regression metrics and baselines.

Model predictions are one long fact table (``validation, feature_group, model,
date, actual, predicted, residual`` + split metadata); every metric is a
grouped aggregate over it.  Splits are labels on rows, never copies of the
frame.  Constant predictors are scored from counts between neighbouring
constants, and baselines keep each row once per way of scoring it
(:class:`Sliced`); the fact table is expanded only where it is wanted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityspark.operators.joins import join_keys
from qualityspark.operators.ranks import quantiles_wide, values_at_ranks
from qualityspark.session import materialize

R = 6


def _r(c: Column) -> Column:
    return F.round(c, R)


# --------------------------------------------------------------------------- A12
def regression_metrics(pred: DataFrame, keys, actual: str = "actual", predicted: str = "predicted",
                       prefix: str = "") -> DataFrame:
    """r2 (sklearn rule: 1.0 / 0.0 when the target is constant), rmse, mae, n;
    rounded to 6 decimals.  One grouped aggregate (partial aggregation)."""
    keys = list(keys)
    y, p = F.col(actual), F.col(predicted)
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(y - p)).alias("_mae"))
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("_sse") / F.col("_sst")))
    return agg.select(*keys, _r(r2).alias(f"{prefix}r2"),
                      _r(F.sqrt(F.col("_sse") / F.col("_n"))).alias(f"{prefix}rmse"),
                      _r(F.col("_mae")).alias(f"{prefix}mae"),
                      F.col("_n").cast("long").alias(f"n_{prefix.rstrip('_')}" if prefix else "n"))


def metric_rows(train: DataFrame | None, test: DataFrame, keys) -> DataFrame:
    """Join train and test metrics, add the train/test gaps."""
    keys = list(keys)
    te = test
    if train is None:
        out = te
        for c in ("train_r2", "train_rmse", "train_mae"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        out = out.withColumn("n_train", F.lit(0).cast("long"))
        return out.withColumn("r2_gap_train_minus_test", F.lit(None).cast("double")) \
                  .withColumn("rmse_gap_test_minus_train", F.lit(None).cast("double"))
    return with_gaps(train.join(te, keys, "inner"))


def with_gaps(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("r2_gap_train_minus_test", _r(F.col("train_r2") - F.col("test_r2"))) \
                  .withColumn("rmse_gap_test_minus_train", _r(F.col("test_rmse") - F.col("train_rmse")))


# fixed values: the R^2 below which both sides underfit; (exclusive upper bound of the
# train - test R^2 gap, label) and the label beyond; the gap counts as overfitting above the last
UNDERFIT_R2 = 0.50
GAP_LABELS = ((0.05, "good_generalization"), (0.10, "acceptable_generalization"))
OVERFIT_GAP = 0.20


def overfit_diagnosis(train_r2: Column, test_r2: Column) -> Column:
    """Label of a train / test R^2 pair."""
    gap = train_r2 - test_r2
    label = F.when(gap > OVERFIT_GAP, "overfitting").otherwise("moderate_gap")
    for bound, name in reversed(GAP_LABELS):
        label = F.when(gap < bound, name).otherwise(label)
    return F.when(F.greatest(train_r2, test_r2) < UNDERFIT_R2, "underfitting").otherwise(label)


# --------------------------------------------------------------------------- V1
def random_split(df: DataFrame, key: Column | None = None, id_col: str = "lot_id",
                 test_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Exactly ceil(test_size * n) test rows: the rows with the smallest
    pseudo-random long ``key`` (default ``xxhash64(id, seed)``).  The cut value is found by
    histogram selection; rows are labelled by comparison and never move."""
    key = key if key is not None else F.xxhash64(F.col(id_col), F.lit(seed))
    _, (cut,) = values_at_ranks(df, key, lambda n: [math.ceil(n * test_size) - 1])
    test = key <= F.lit(cut) if cut is not None else F.lit(False)
    return df.withColumn(name, F.when(test, F.lit("test")).otherwise(F.lit("train")))


# --------------------------------------------------------------------------- baselines
def _const_preds(labelled: DataFrame, split_keys, target: str, models=("mean", "median")) -> DataFrame:
    """Per split: mean / median of the training target (exact median)."""
    tr = labelled.where(F.col("split") == "train")
    out = None
    if "mean" in models:
        m = tr.groupBy(*split_keys).agg(F.avg(target).alias("value")).withColumn("model", F.lit("mean"))
        out = m
    if "median" in models:
        md = quantiles_wide(tr, split_keys, target, {"value": 0.5}).drop("n") \
            .withColumn("model", F.lit("median"))
        out = md if out is None else out.unionByName(md)
    return out


def constant_metrics(rows: DataFrame, source_keys, slices: DataFrame, target: str, prefix: str = "") -> DataFrame:
    """A12 of constant predictions without a row copy per constant.  ``slices``: one row per
    (slice, ``value``) naming the rows it is scored on by ``source_keys`` (no other name in common
    with ``rows``).  A row is counted in the one cell of its source between two neighbouring constants;
    squared and absolute errors of every constant follow from the cells' counts, sums and moments.
    There are sources x (constants + 1) cells at most, a number set by the validation design.
    Slices without rows give no row."""
    src, y = list(source_keys), F.col(target)
    own = [c for c in slices.columns if c not in src + ["value"]]
    cuts = slices.groupBy(*src).agg(F.array_sort(F.collect_set("value")).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_y")))
    cells = join_keys(rows.select(*src, y.alias("_y")), F.broadcast(cuts), src).where("_y IS NOT NULL") \
        .groupBy(*src, below.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_s"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"),
            F.var_pop("_y").alias("_v"), F.avg("_y").alias("_m"))
    # a cell of equal values has its value as mean, without the rounding of a sum
    n, m = F.col("_c"), F.col("_m")
    cells = cells.withColumn("_m", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(m))
    whole = Window.partitionBy(*src)                                     # the cells of a source
    cells = cells.withColumn("_mean", F.sum(n * m).over(whole) / F.sum(n).over(whole))
    place = F.size(F.filter("_cuts", lambda c: c < F.col("value")))
    j = join_keys(join_keys(slices, F.broadcast(cuts), src).withColumn("_place", place).drop("_cuts"), cells, src)
    c, s, within = F.col("value"), F.col("_s"), F.col("_c") * F.col("_v")
    around = lambda v: F.sum(within + n * (m - v) * (m - v))
    agg = j.groupBy(*src, *own, "value").agg(
        F.sum(n).alias("_n"), around(c).alias("_sse"), around(F.col("_mean")).alias("_sst"),
        F.min("_lo").alias("_least"), F.max("_hi").alias("_most"),
        F.sum(F.when(F.col("_cell") <= F.col("_place"), n * c - s).otherwise(s - n * c)).alias("_abs"))
    n, sse, sst = F.col("_n"), F.col("_sse"), F.col("_sst")
    r2 = F.when(F.col("_least") == F.col("_most"), (sse == 0).cast("double")).otherwise(1 - sse / sst)
    name = f"n_{prefix.rstrip('_')}" if prefix else "n"
    return agg.select(*src, *own, "value", _r(r2).alias(f"{prefix}r2"), _r(F.sqrt(sse / n)).alias(f"{prefix}rmse"),
                      _r(F.greatest(F.col("_abs"), F.lit(0.0)) / n).alias(f"{prefix}mae"), n.cast("long").alias(name))


@dataclass
class Sliced:
    """Test predictions of baselines, each row once per way of scoring it.  ``sources``: rows
    (``keys``, ``date``, ``actual``, ``predicted``, the id), ``predicted`` NULL where slices bring a
    constant (``scorer`` = constant).  ``slices``: one row per prediction slice with the ``keys`` of its
    source and the constant in ``value``; their number is set by the validation design."""
    sources: DataFrame
    slices: DataFrame
    keys: list

    def rows(self) -> DataFrame:
        """The prediction fact table: the rows of every slice."""
        j = join_keys(self.sources, F.broadcast(self.slices), self.keys)
        return j.withColumn("predicted", F.when(F.col("scorer") == "constant", F.col("value"))
                            .otherwise(F.col("predicted"))).drop("scorer", "value")


def union_sliced(parts) -> Sliced:
    """U2 of sliced predictions: columns that a design lacks are NULL."""
    parts = list(parts)
    keys = list(dict.fromkeys(k for p in parts for k in p.keys))
    one = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return Sliced(one([p.sources for p in parts]), one([p.slices for p in parts]), keys)


def _ids(df: DataFrame) -> list[str]:
    return ["lot_id"] if "lot_id" in df.columns else []


def constant_and_previous_baselines(labelled: DataFrame, split_keys, target: str, lag_col: str | None,
                                    validation: str, min_lag_rows: int = 2):
    """V6 + V7 on a frame labelled with ``split`` (train/test) and split keys.
    Returns (metrics, test predictions as :class:`Sliced`)."""
    split_keys = list(split_keys)
    keys = split_keys + ["model"]
    tag = {"validation": F.lit(validation), "feature_group": F.lit("baseline")}
    consts = materialize(_const_preds(labelled, split_keys, target))      # one row per split and model
    sides = consts.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    scores = constant_metrics(labelled, split_keys + ["split"], sides, target).drop("value")
    test = F.col("split") == "test"
    base = [*split_keys, "date", F.col(target).alias("actual"), *_ids(labelled)]
    sources = labelled.where(test).select(*base, F.lit("constant").alias("scorer"), F.lit(None).cast("double").alias("predicted"))
    slices = consts.withColumn("scorer", F.lit("constant"))
    if lag_col:
        prev = labelled.where(F.col(lag_col).isNotNull()).withColumn("model", F.lit("previous_value"))
        own = regression_metrics(prev, keys + ["split"], target, lag_col)
        ok = own.groupBy(*keys).agg(F.min("n").alias("_least"), F.count(F.lit(1)).alias("_sides")).where(
            (F.col("_least") >= min_lag_rows) & (F.col("_sides") == 2)).select(*keys)
        scores = scores.unionByName(join_keys(own, F.broadcast(ok), keys, "left_semi"))
        sources = sources.unionByName(prev.where(test).select(
            *base, F.lit("previous_value").alias("scorer"), F.col(lag_col).cast("double").alias("predicted")))
        slices = slices.unionByName(ok.withColumns({"value": F.lit(None).cast("double"), "scorer": F.lit("previous_value")}))
    side = lambda name, c: F.max(F.when(F.col("split") == name, F.col(c)))
    wide = scores.groupBy(*keys).agg(
        *[side(s, c).alias(f"{s}_{c}") for s in ("train", "test") for c in ("r2", "rmse", "mae")],
        *[side(s, "n").alias(f"n_{s}") for s in ("train", "test")]).where("n_train IS NOT NULL AND n_test IS NOT NULL")
    return with_gaps(wide).withColumns(tag), Sliced(sources.withColumns(tag), slices.withColumns(tag),
                                                    ["validation", "feature_group", *split_keys, "scorer"])


def year_pairs(df: DataFrame, year_col: str = "year", min_rows: int = 20) -> DataFrame:
    """Ordered pairs of distinct years that both have >= min_rows rows.
    Built from the per-year count table, so at most (#years)^2 rows."""
    yc = df.groupBy(F.col(year_col).alias("y")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_rows)
    a, b = yc.select(F.col("y").alias("train_year")), yc.select(F.col("y").alias("test_year"))
    return a.join(F.broadcast(b), F.col("train_year") != F.col("test_year"))


def year_holdout_baselines(df: DataFrame, target: str, lag_col: str | None, year_col: str = "year",
                           min_rows: int = 20, min_lag_rows: int = 2):
    """V2 + V6 + V7 for every ordered year pair.

    No row is scored once per other year: the constants of all years are scored from cell
    counts of each year (its own constants give the train side), and the previous-value
    model does not depend on the training set, so it is scored once per year.  Returns
    (metrics, test predictions as :class:`Sliced`, one source per test year)."""
    tag = {"validation": F.lit("year_holdout"), "feature_group": F.lit("baseline")}
    base = df.withColumn("test_year", F.col(year_col))
    pairs = materialize(year_pairs(df, year_col, min_rows))               # years x years
    consts = _const_preds(base.withColumn("split", F.lit("train")), ["test_year"], target)
    consts = materialize(consts.withColumnRenamed("test_year", "train_year"))
    both = pairs.unionByName(pairs.select("train_year", F.col("train_year").alias("test_year")).distinct())
    scores = materialize(constant_metrics(base, ["test_year"], both.join(consts, "train_year"), target).drop("value"))
    same = F.col("train_year") == F.col("test_year")
    metrics = metric_rows(_sided(scores.where(same).drop("test_year"), "train"), _sided(scores.where(~same), "test"),
                          ["train_year", "model"])
    rows = [F.col(target).alias("actual"), "test_year", "date", *_ids(df)]
    sources = base.select(*rows, F.lit("constant").alias("scorer"), F.lit(None).cast("double").alias("predicted"))
    slices = pairs.join(consts, "train_year").withColumn("scorer", F.lit("constant"))
    if lag_col:
        lg = base.where(F.col(lag_col).isNotNull())
        per_year = materialize(regression_metrics(lg, ["test_year"], target, lag_col).where(F.col("n") >= min_lag_rows))
        okp = pairs.join(per_year.select("test_year"), "test_year", "left_semi").join(
            per_year.select(F.col("test_year").alias("train_year")), "train_year", "left_semi")
        tr = _sided(per_year.withColumnRenamed("test_year", "train_year"), "train")
        pm = metric_rows(okp.join(tr, "train_year"), _sided(per_year, "test"), ["test_year"])
        metrics = metrics.unionByName(pm.withColumn("model", F.lit("previous_value")))
        sources = sources.unionByName(lg.select(
            *rows, F.lit("previous_value").alias("scorer"), F.col(lag_col).cast("double").alias("predicted")))
        slices = slices.unionByName(okp.withColumns({"model": F.lit("previous_value"), "scorer": F.lit("previous_value"),
                                                     "value": F.lit(None).cast("double")}))
    return metrics.withColumns(tag), Sliced(sources.withColumns(tag), slices.withColumns(tag),
                                            ["validation", "feature_group", "test_year", "scorer"])


def _sided(metrics: DataFrame, side: str) -> DataFrame:
    return metrics.withColumnsRenamed({c: f"{side}_{c}" for c in ("r2", "rmse", "mae")} | {"n": f"n_{side}"})


def blocked_labelled(ordered, train_fraction: float = 0.8, min_rows: int = 20) -> DataFrame:
    """W8 + guard on an :class:`Ordered` frame (positions computed here)."""
    ix = ordered.row_number("_pos")
    return blocked_from_index(ix, "_pos", "_n", train_fraction, min_rows).drop("_pos", "_idx")


def blocked_from_index(df: DataFrame, idx_col: str, n_col: str, train_fraction: float = 0.8,
                       min_rows: int = 20) -> DataFrame:
    """W8 from an existing 1-based position and series size: the first
    floor(f * n) rows are train; both sides need >= min_rows rows."""
    cut = F.floor(F.col(n_col) * F.lit(train_fraction))
    lab = df.withColumn("split", F.when(F.col(idx_col) <= cut, F.lit("train")).otherwise(F.lit("test"))) \
            .where((cut >= min_rows) & (F.col(n_col) - cut >= min_rows))
    dates = lab.groupBy().agg(
        F.date_format(F.min(F.when(F.col("split") == "train", F.col("date"))), "yyyy-MM-dd").alias("train_date_min"),
        F.date_format(F.max(F.when(F.col("split") == "train", F.col("date"))), "yyyy-MM-dd").alias("train_date_max"),
        F.date_format(F.min(F.when(F.col("split") == "test", F.col("date"))), "yyyy-MM-dd").alias("test_date_min"),
        F.date_format(F.max(F.when(F.col("split") == "test", F.col("date"))), "yyyy-MM-dd").alias("test_date_max"))
    return lab.crossJoin(F.broadcast(dates))          # one row


# --------------------------------------------------------------------------- V8
def monthly_rolling_baselines(df: DataFrame, target: str, lag_col: str | None, date_col: str = "date",
                              min_train_months: int = 3, min_train_samples: int = 60,
                              min_test_samples: int = 5):
    """Each month is a test window; the training set is every earlier month.

    The expanding mean comes from cumulative sums over the month table.  The
    expanding median needs the order statistic of all earlier rows: the
    per-month value-count table is joined to every later month (months are
    few, and the join is on value counts, not rows) and the exact rank engine
    finds the median per test month.
    Returns (metrics pooled per model, test predictions as :class:`Sliced`)."""
    d = df.withColumn("_period", F.date_trunc("month", F.col(date_col)))
    months = d.groupBy("_period").agg(F.count(F.lit(1)).alias("_cnt"), F.sum(target).alias("_sum"))
    wm = Window.orderBy("_period")   # month table: one row per calendar month
    months = months.select(
        "_period", "_cnt",
        (F.row_number().over(wm) - 1).alias("_pidx"),
        F.coalesce(F.sum("_cnt").over(wm.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ntr"),
        F.sum("_sum").over(wm.rowsBetween(Window.unboundedPreceding, -1)).alias("_str"),
        F.first("_period").over(wm.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_p0"),
        F.lag("_period").over(wm).alias("_pend"))
    windows = months.where((F.col("_pidx") >= min_train_months) & (F.col("_ntr") >= min_train_samples)
                           & (F.col("_cnt") >= min_test_samples)).select(
        "_period", (F.col("_str") / F.col("_ntr")).alias("_mean"),
        F.date_format("_period", "yyyy-MM").alias("test_period"),
        F.date_format("_p0", "yyyy-MM").alias("train_period_start"),
        F.date_format("_pend", "yyyy-MM").alias("train_period_end"))
    # expanding median: exact prefix quantile over earlier months (rank engine bins)
    from qualityspark.operators.ranks import prefix_quantiles
    medl = prefix_quantiles(d, "_period", target, windows.select("_period"), [0.5]).select(
        "_period", F.col("quantile").alias("_median"))
    win = windows.join(medl, "_period")
    rows = d.join(F.broadcast(win), "_period")
    base = [F.col(target).alias("actual"), "date", "test_period", "train_period_start", "train_period_end",
            *(["lot_id"] if "lot_id" in df.columns else [])]
    p_mean = rows.select(*base, F.col("_mean").alias("predicted"), F.lit("mean").alias("model"))
    p_med = rows.select(*base, F.col("_median").alias("predicted"), F.lit("median").alias("model"))
    preds = p_mean.unionByName(p_med)
    if lag_col:
        lr = rows.where(F.col(lag_col).isNotNull())
        okp = lr.groupBy("_period").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_test_samples)
        lr = lr.join(F.broadcast(okp.select("_period")), "_period", "left_semi")
        preds = preds.unionByName(lr.select(*base, F.col(lag_col).alias("predicted"),
                                            F.lit("previous_value").alias("model")))
    preds = preds.withColumn("validation", F.lit("monthly_rolling")).withColumn("feature_group", F.lit("baseline"))
    te = regression_metrics(preds, ["model"], prefix="test_")
    extra = preds.groupBy("model").agg(
        F.count_distinct("test_period").alias("n_windows"),
        F.min("test_period").alias("test_period_start"), F.max("test_period").alias("test_period_end"))
    metrics = metric_rows(None, te.join(extra, "model"), ["model"]) \
        .withColumn("validation", F.lit("monthly_rolling")).withColumn("feature_group", F.lit("baseline"))
    # the constants change by month, so a slice's rows carry their prediction
    slices = preds.sparkSession.createDataFrame([(m, m, None) for m in ("mean", "median", "previous_value")],
                                                "model string, scorer string, value double")
    tag = {"validation": F.lit("monthly_rolling"), "feature_group": F.lit("baseline")}
    return metrics, Sliced(preds.withColumnRenamed("model", "scorer"), slices.withColumns(tag),
                           ["validation", "feature_group", "scorer"])


def with_residual(preds: DataFrame) -> DataFrame:
    """V9."""
    return preds.withColumn("residual", F.col("actual") - F.col("predicted"))

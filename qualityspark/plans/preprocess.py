"""End-to-end preprocessing (the reference's first entry point, E1).

typed frame -> transition breakpoint (on unclipped data) -> time features ->
month-wise IQR clip -> missing-value handling -> log features -> normality,
correlations, VIF selection -> model-ready projection; plus the run summary.
Every step is a DataFrame operator; outputs are DataFrames, and published as one run
(``sources.sinks.publish``) where an output folder is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.functions.numeric import log1p_clipped, month_dummies
from qualityspark.operators.breakpoint import apply_transition_flag, transition_report
from qualityspark.operators.correlation import (normality_report, pearson_matrix, primary_method,
                                                spearman_matrix)
from qualityspark.operators.gram import gram, select_by_vif, vif_from_gram
from qualityspark.operators.ordered import Ordered, mode_of
from qualityspark.operators.outliers import iqr_clip_by_month
from qualityspark.operators.profile import descriptive_stats, missing_counts, monthly_boxplot_stats
from qualityspark.operators.ranks import quantiles_wide
from qualityspark.operators.outliers import to_long
from qualityspark.schema import RAW_COLUMNS, QualitySchema
from qualityspark.session import materialize
from qualityspark.sources.sinks import json_safe, publish

#: results that are written as datasets, the others as reports
DATASETS = ("typed", "processed_full", "model_ready", "model_source")

#: a column per category is only made for so many of them; more is an error, not a cut
MAX_LEVELS = 2000


def add_time_features(df: DataFrame, report: DataFrame, schema: QualitySchema) -> DataFrame:
    """month, row-number trend (W1), transition flag (O4), month_1..12."""
    d = df.withColumn("month", F.month(schema.date))
    d = apply_transition_flag(d, report, schema.date)
    d = Ordered(d, schema.date, schema.tie, schema.series).row_number("time_trend").drop("_idx", "_n")
    return d.select("*", *month_dummies(F.col("month")))


def handle_missing_values(df: DataFrame, schema: QualitySchema, numeric, categorical,
                          exclude=()) -> DataFrame:
    """W2 + W3 + W4: interpolate numerics by position (both directions), then
    the column median; categoricals forward/backward filled, then the mode,
    then 'UNKNOWN'.  The target is excluded from imputation.  Rows are placed in order once for
    both, and the filled frame is written before its medians are read."""
    numeric, categorical = [c for c in numeric if c not in set(exclude)], list(categorical)
    if not numeric and not categorical:
        return df
    o = Ordered(df, schema.date, schema.tie, schema.series)
    rows = o.indexed()
    modes = None
    for c in categorical:
        m = mode_of(rows if numeric else df, c)
        modes = m if modes is None else modes.crossJoin(m)                           # one row each
    fallback = {}
    if categorical:
        row = modes.first()
        fallback = {c: F.lit(row[f"{c}_mode"]).cast(df.schema[c].dataType) for c in categorical}
    d = o.interpolate_and_fill(numeric, categorical, fallback).drop("_idx", "_n")
    if numeric:
        d = materialize(d)
        med = quantiles_wide(to_long(d, numeric), ["feature"], "value", {"m": 0.5})   # k rows
        wide = med.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"_md_{c}") for c in numeric])
        d = d.crossJoin(F.broadcast(wide))                                           # one row
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_md_{c}")) for c in numeric}) \
             .drop(*[f"_md_{c}" for c in numeric])
    return d


def add_log_features(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({f"log_{c}": log1p_clipped(F.col(c)) for c in columns if c in df.columns})


def one_hot_sorted(df: DataFrame, columns) -> DataFrame:
    """X1 (EDA variant): one 0/1 column per observed category, sorted names;
    the category list is a small distinct table."""
    new = {}
    for c in columns:
        levels = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} categories: too many for one column each")
        new |= {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in levels}
    return df.withColumns(new)


def build_model_ready(df: DataFrame, target: str, base_features, vif_columns, kept_vif, categorical) -> DataFrame:
    """Date, target, base features minus target-derived and VIF-dropped,
    month_2..12, one-hot categoricals (encoded before the target filter)."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to predict")
    derived = {target, "log_" + target}
    base = [c for c in base_features if c not in derived and (c not in vif_columns or c in set(kept_vif))]
    months = [f"month_{k}" for k in range(2, 13)]
    enc = one_hot_sorted(df, categorical)
    ohe = [c for c in enc.columns if any(c.startswith(f"{k}_") for k in categorical) and c not in df.columns]
    keep = list(dict.fromkeys(["date", target] + [c for c in base if c in df.columns] +
                              [m for m in months if m in df.columns]))
    return enc.select(*keep, *ohe).where(F.col(target).isNotNull())


def run_summary(before: DataFrame, after: DataFrame, date_col: str = "date") -> DataFrame:
    """One row of counts, date range and months present."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"),
                  F.date_format(F.min(date_col), "yyyy-MM-dd").alias("date_min"),
                  F.date_format(F.max(date_col), "yyyy-MM-dd").alias("date_max"),
                  F.array_join(F.array_sort(F.collect_set(F.month(date_col))), ",").alias("months_present"))
    return b.crossJoin(a)


def summary_sections(parts: dict) -> DataFrame:
    """A7 in full, from the results of ``run_preprocess``: (section, item, value), value a JSON object.
    Non-finite numbers are left out.  Every section is of result size."""
    spark = parts["summary"].sparkSession

    def section(name, df, item=None):
        rest = [c for c in df.columns if c != item]
        return json_safe(df).select(F.lit(name).alias("section"), (F.col(item).cast("string") if item else F.lit("all")).alias("item"),
                                    F.to_json(F.struct(*rest)).alias("value"))

    def factors(rows):
        return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, vif double")

    chosen = parts["vif_selection"]
    history = [(h["removed_feature"], i + 1, float(h["vif_at_removal"])) for i, h in enumerate(chosen["removal_history"])]
    kept = [(f, "kept") for f in chosen["kept_features"]] + [(f, "removed") for f in chosen["removed_features"]]
    tables = [
        section("rows", parts["summary"]),
        section("missing_before", parts["missing_before"], "feature"), section("missing_after", parts["missing_after"], "feature"),
        section("outliers_clipped", parts["outlier_counts"], "feature"),
        section("transition", parts["transition_report"], "year"),
        section("correlation", parts["correlation_method"]),
        section("normality", parts["normality"], "feature"),
        section("vif_before", factors(parts["vif_before"]), "feature"), section("vif_after", factors(chosen["final_vif"]), "feature"),
        section("vif_selection", spark.createDataFrame(kept, "feature string, decision string"), "feature"),
        section("vif_removals", spark.createDataFrame(history, "feature string, step int, vif_at_removal double"), "feature"),
    ]
    if "input_metadata" in parts:
        tables.append(section("input", parts["input_metadata"]))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def run_preprocess(typed: DataFrame, schema: QualitySchema, iqr_columns, transition_columns,
                   corr_columns, vif_columns, base_features, log_columns, vif_threshold: float = 10.0,
                   profile_columns=None, boxplot_columns=None, encode_columns=None, wanted=None,
                   input_metadata: DataFrame | None = None, publish_to: tuple[str, str] | None = None) -> dict:
    """The whole first entry point.  ``encode_columns``: categoricals to one-hot
    encode (all by default).  ``wanted``: names of the results to make (all by default); the jobs
    of the others are not run.  ``input_metadata``: the reader's one-row table, for the summary.
    ``publish_to``: (folder, run id) to write the results to.  Returns a dict of DataFrames / small dicts."""
    target = schema.target
    typed = materialize(typed)
    report = transition_report(typed, list(dict.fromkeys(list(transition_columns) + [target])), schema.date)
    with_time = add_time_features(typed, report, schema)
    clip_cols = [c for c in iqr_columns if c != target]
    clipped, outliers, bounds = iqr_clip_by_month(with_time, clip_cols)
    imputed = handle_missing_values(clipped, schema, list(schema.measures), list(schema.categoricals),
                                    exclude=[target])
    featured = materialize(add_log_features(imputed, log_columns))
    prof_cols = profile_columns or list(schema.measures) + [f"log_{c}" for c in log_columns]
    encode = encode_columns if encode_columns is not None else list(schema.categoricals)
    made: dict = {}

    def once(name, make):
        if name not in made:
            made[name] = make()
        return made[name]

    products = lambda: once("gram", lambda: gram(featured, vif_columns))
    part = lambda name: once(name, results[name])
    in_summary = ("summary", "missing_before", "missing_after", "outlier_counts", "transition_report", "correlation_method",
                  "normality", "vif_before", "vif_selection")
    whole_summary = lambda: summary_sections({n: part(n) for n in in_summary} | (
        {} if input_metadata is None else {"input_metadata": input_metadata}))
    results = {
        "typed": lambda: typed, "transition_report": lambda: report, "processed_full": lambda: featured,
        "model_ready": lambda: build_model_ready(featured, target, base_features, vif_columns, part("vif_selection")["kept_features"], encode),
        "outlier_counts": lambda: outliers, "iqr_bounds": lambda: bounds,
        "missing_before": lambda: missing_counts(typed), "missing_after": lambda: missing_counts(featured),
        "normality": lambda: materialize(normality_report(featured, corr_columns)),
        "correlation_method": lambda: primary_method(part("normality")),
        "pearson": lambda: pearson_matrix(featured, corr_columns), "spearman": lambda: spearman_matrix(featured, corr_columns),
        "vif_before": lambda: vif_from_gram(products(), vif_columns), "vif_selection": lambda: select_by_vif(products(), vif_columns, vif_threshold),
        "descriptive": lambda: descriptive_stats(featured, [c for c in prof_cols if c in featured.columns]),
        "monthly_boxplot": lambda: monthly_boxplot_stats(featured, boxplot_columns or list(corr_columns)),
        "model_source": lambda: typed.select(*[c for c in [*RAW_COLUMNS, "source_file"] if c in typed.columns]),
        "summary": lambda: run_summary(typed, featured, schema.date), "summary_sections": whole_summary,
    }
    out = {name: part(name) for name in results if wanted is None or name in wanted}
    if publish_to is not None:
        publish(typed.sparkSession, *publish_to, out, DATASETS, schema.date)
    return out

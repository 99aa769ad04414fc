"""OLS entry point (E2): base fit, exhaustive subset search, lagged fit,
residual diagnostics and the autocorrelation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.operators.gram import best_subset, gram, non_constant, ols_from_gram, residual_diagnostics
from qualityspark.operators.ordered import Ordered
from qualityspark.schema import target_safe
from qualityspark.session import materialize
from qualityspark.sources.sinks import publish


def run_ols(model_ready: DataFrame, target: str, candidates, fixed, date_col: str = "date", tie=(),
            publish_to: tuple[str, str] | None = None) -> dict:
    """``publish_to``: (folder, run id) to write the results to."""
    df = materialize(model_ready.where(F.col(target).isNotNull()))
    cands = [c for c in target_safe(candidates, target) if c in df.columns]
    if not cands:
        raise ValueError("No available independent variables after excluding the target column.")
    fixed = non_constant(df, [c for c in fixed if c in df.columns])
    g = gram(df, [target] + fixed + cands)
    base = ols_from_gram(g, target, cands)
    best, log = best_subset(g, target, fixed, cands)
    ordered = Ordered(df, date_col, tie)
    lagged = materialize(ordered.lag_features(target).where(F.col(f"{target}_lag1").isNotNull()))
    feats = best.features + [f"{target}_lag1"]
    lag_fit = ols_from_gram(gram(lagged, [target] + feats), target, feats)
    diag = residual_diagnostics(lagged, lag_fit, ordered=lambda f: Ordered(f, date_col, tie))
    acf = Ordered(lagged, date_col, tie).acf(target, 40)
    out = {"base": base, "best": best, "subset_log": log, "lag_frame": lagged, "lag_fit": lag_fit,
           "lag_diagnostics": diag, "acf": acf}
    if publish_to is not None:
        publish(df.sparkSession, *publish_to, out, ("lag_frame",), date_col)
    return out

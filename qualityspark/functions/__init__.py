"""Column expressions (JVM-side, codegen friendly)."""

from qualityspark.functions.text import (
    normalize_numeric_text,
    normalize_category,
    parse_date,
)
from qualityspark.functions.numeric import (
    clip,
    log1p_clipped,
    month_dummies,
    non_finite_to_null,
    nan_to_null,
    safe_div,
    threshold_name,
    round6,
)

__all__ = [
    "normalize_numeric_text", "normalize_category", "parse_date", "clip",
    "log1p_clipped", "month_dummies", "non_finite_to_null", "nan_to_null",
    "safe_div", "threshold_name", "round6",
]

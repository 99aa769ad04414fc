"""Column roles.

Operators are generic over a :class:`QualitySchema`; column names are
parameters.  Two presets ship: the plant layout of the monthly lab files
(``PLANT``) and the ``lots`` view that adapts the driver's order tables
(``LOTS``).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualitySchema:
    date: str
    target: str
    measures: tuple[str, ...]
    categoricals: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()          # columns that break ties after the date
    series: tuple[str, ...] = ()       # optional independent series (plant, line)
    extra: dict = field(default_factory=dict)

    @property
    def order(self) -> tuple[str, ...]:
        return (self.date,) + tuple(self.tie)

    def features(self, exclude_target: bool = True) -> list[str]:
        """Measures minus the target and its log (the leakage guard)."""
        banned = {self.target, "log_" + self.target} if exclude_target else set()
        return [c for c in self.measures if c not in banned]


def require_columns(df, columns, what="input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def target_safe(features, target) -> list[str]:
    banned = {target, "log_" + target}
    return [c for c in dict.fromkeys(features) if c not in banned]


# ---------------------------------------------------------------------------
# Fixed values of the plant file layout (must equal the source layout).
# Positional names of the 20 columns of a monthly block, in file order.
RAW_COLUMNS = [
    "date",
    "acid_dosing_pct",
    "bleaching_earth_dosing_pct",
    "feed_tank",
    "feed_ffa_pct",
    "feed_mi_pct",
    "feed_iv",
    "feed_dobi",
    "feed_car_pv",
    "feed_p_ppm",
    "feed_type",
    "rbd_tank",
    "rbd_ffa_pct",
    "rbd_mi_pct",
    "rbd_iv",
    "rbd_pv",
    "rbd_color",
    "rbd_odor",
    "rbd_p_ppm",
    "rbd_type",
]
NUMERIC_COLUMNS = [
    "acid_dosing_pct", "bleaching_earth_dosing_pct", "feed_ffa_pct", "feed_mi_pct",
    "feed_iv", "feed_dobi", "feed_car_pv", "feed_p_ppm", "rbd_ffa_pct", "rbd_mi_pct",
    "rbd_iv", "rbd_pv", "rbd_color", "rbd_odor", "rbd_p_ppm",
]
CATEGORICAL_COLUMNS = ["feed_tank", "feed_type", "rbd_tank", "rbd_type"]
IQR_COLUMNS = [
    "feed_dobi", "feed_ffa_pct", "feed_mi_pct", "feed_iv", "feed_p_ppm",
    "rbd_ffa_pct", "rbd_mi_pct", "rbd_iv", "rbd_p_ppm",
]
VIF_COLUMNS = ["feed_dobi", "feed_ffa_pct", "feed_mi_pct", "feed_iv", "feed_car_pv"]
TRANSITION_BASE_COLUMNS = ["feed_dobi", "feed_ffa_pct", "feed_mi_pct", "feed_iv"]
BOXPLOT_COLUMNS = ["feed_dobi", "feed_ffa_pct", "feed_mi_pct", "feed_iv", "feed_p_ppm", "rbd_p_ppm"]
LOG_COLUMNS = ["feed_ffa_pct", "feed_p_ppm", "rbd_p_ppm"]
# Text cells that mean "no measurement" (compared after trim + upper case).
STOP_TOKENS = ["STOP", "PLANT STOPPED"]
# Category cells that mean "missing" after normalisation.
MISSING_CATEGORY_TOKENS = ["", "nan", "NaN", "NAN", "None"]
# ---------------------------------------------------------------------------

PLANT = QualitySchema(
    date="date",
    target="feed_p_ppm",
    measures=tuple(NUMERIC_COLUMNS),
    categoricals=tuple(CATEGORICAL_COLUMNS),
    tie=("source_file", "sheet_name", "row_pos"),
)

# The `lots` view over the driver tables (see qualityspark.sources.tables).
LOTS = QualitySchema(
    date="date",
    target="target",
    measures=("ffa", "car_pv", "mi", "iv", "dobi", "target"),
    categoricals=("tank", "type"),
    tie=("lot_id",),
)

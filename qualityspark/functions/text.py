"""Text normalisation of raw cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType, TimestampNTZType, DateType

from qualityspark.schema import STOP_TOKENS

# A plain decimal / scientific number, as accepted by a strict numeric parser.
# Suffixes such as "1.5d" or thousands separators such as "1,234" are rejected.
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITY = r"^[+-]?(INF|INFINITY)$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_numeric_text(c: Column | str) -> Column:
    """Trim, upper-case, map blank / stop tokens to NULL, then parse as double.

    Text that is not a number becomes NULL; ``NAN`` becomes NULL (missing), an
    infinity spelled out stays infinite.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.upper(_strip(c.cast(StringType())))
    stop = s.isin(*STOP_TOKENS) | (s == F.lit(""))
    return (
        F.when(c.isNull() | stop, F.lit(None).cast("double"))
        .when(s.rlike(_NUMBER), s.try_cast("double"))
        .when(s.rlike(_INFINITY), F.when(s.startswith("-"), F.lit(float("-inf")))
              .otherwise(F.lit(float("inf"))))
        .otherwise(F.lit(None).cast("double"))
    )


def normalize_category(c: Column | str) -> Column:
    """Upper-case, delete all whitespace; blank and ``NAN`` become NULL.

    Matching happens after upper-casing, so a literal "None" survives as the
    category ``NONE`` while "nan" is missing.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.upper(c.cast(StringType())), r"\s+", "")
    return F.when(c.isNull() | s.isin("", "NAN"), F.lit(None).cast("string")).otherwise(s)


def parse_date(c: Column | str, data_type=None) -> Column:
    """Coerce to timestamp; unparsable text becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(data_type, (TimestampType, TimestampNTZType)):
        return c
    if isinstance(data_type, DateType):
        return c.cast("timestamp")
    return F.try_to_timestamp(_strip(c.cast(StringType())))

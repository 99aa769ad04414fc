"""Rows in total order, cut into bounded buckets.

``place`` sorts a frame by range partitions of its full order key (Spark samples
the bounds, so dates at midnight, mixed timestamps, clustered ids or a few huge
values all give even partitions) and writes it once.  The position inside a
partition then cuts it into buckets of at most ``limit`` rows, so a bucket is
bounded whatever the data.  After the write the numbering is fixed: a task that
is run again reads the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.session import materialize

_LOCAL = (1 << 33) - 1


def place(df: DataFrame, order: Sequence[str], limit: int, bucket: str = "_b0") -> DataFrame:
    """``df`` with ``_mid`` (position, ascending in ``order``; consecutive inside
    a bucket) and ``bucket`` (ascending in ``order``, at most ``limit`` rows)."""
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_mid", F.monotonically_increasing_id()))
    at = F.col("_mid").bitwiseAND(F.lit(_LOCAL))
    return rows.withColumn(bucket, F.col("_mid") - at + F.floor(at / F.lit(int(limit))).cast("long"))


def partition_of(bucket: Column) -> Column:
    """Number of the range partition that a bucket (or a ``_mid``) lies in."""
    return F.shiftright(bucket, 33)

"""qualityspark: Spark-native analytics for dated process-quality records.

Every operator takes and returns DataFrames; the heavy lifting is Spark SQL
(aggregations, joins, windows).  See README.md for the module map.
"""

from qualityspark.session import get_spark, checkpoint_dir
from qualityspark.schema import QualitySchema, LOTS

__all__ = ["get_spark", "checkpoint_dir", "QualitySchema", "LOTS"]

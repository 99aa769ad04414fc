"""Streaming ingest of monthly blocks.

The reference has no streaming operators: every input is a file read once.
The one place where a stream fits is the arrival of new monthly files; this
package ingests them incrementally with Structured Streaming's file source
(exactly-once per file through the checkpoint), reusing the batch parser.
"""

from qualityspark.streaming.monthly_files import start_monthly_ingest

__all__ = ["start_monthly_ingest"]

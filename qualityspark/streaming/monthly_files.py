"""Incremental ingest of newly arriving monthly block files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.schema import RAW_COLUMNS
from qualityspark.sources.monthly import LEAD_ROWS, SUFFIX_GLOB, _line_schema, type_block


def parse_stream(spark: SparkSession, folder: str, sep: str = ",", max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming version of ``read_blocks`` + ``type_block``: one file per
    row (a month of one plant), lines with their position, typed cells."""
    raw = (spark.readStream.format("text").option("wholetext", True)
           .option("pathGlobFilter", SUFFIX_GLOB).option("maxFilesPerTrigger", max_files_per_trigger)
           .load(folder)
           .select("value", F.col("_metadata.file_name").alias("source_file")))
    raw = raw.where(~F.col("source_file").startswith("~$"))
    lines = raw.select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("row_pos", "line")) \
               .where((F.col("row_pos") >= LEAD_ROWS) & (F.trim("line") != ""))
    parsed = lines.select("source_file", F.col("row_pos").cast("long"),
                          F.from_csv("line", _line_schema(len(RAW_COLUMNS) + 1).simpleString(), {"sep": sep})
                          .alias("r"))
    cells = parsed.select(*[F.col(f"r.c{i + 1}").alias(n) for i, n in enumerate(RAW_COLUMNS)],
                          F.regexp_replace("source_file", r"\.[^.]*$", "").alias("sheet_name"),
                          "source_file", "row_pos")
    return type_block(cells).withColumn("year", F.year("date"))


def start_monthly_ingest(spark: SparkSession, folder: str, out_path: str, checkpoint: str,
                         once: bool = True, sep: str = ","):
    """Append typed rows of new files to a year-partitioned Parquet table.
    ``once``: process what is there and stop (``availableNow``)."""
    q = (parse_stream(spark, folder, sep).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .partitionBy("year").outputMode("append"))
    q = q.trigger(availableNow=True) if once else q.trigger(processingTime="1 minute")
    return q.start()

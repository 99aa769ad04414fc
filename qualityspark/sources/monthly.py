"""Monthly lab-block ingest.

A monthly block is a delimited text file (one file per sheet): four lead
rows, an unused first column, then the 20 positional columns of
``schema.RAW_COLUMNS``.  Files are read by line in byte ranges (splits), so one large
file is many tasks.  Lines are written once with an ascending number; a table of one row per
range (lines, first number) then gives every range its place in the file, and a line's
position is the lines before its range plus its place there.  Rows are not shuffled
as long as that table is small enough for Spark to broadcast it.
File discovery is Spark's own (glob filter, lock files excluded), so the
listing also works on a cluster file system.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from qualityspark.functions.text import normalize_category, normalize_numeric_text, parse_date
from qualityspark.operators.profile import filter_years, ingest_metadata, parse_year_filter
from qualityspark.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS
from qualityspark.session import materialize

LEAD_ROWS = 4
SUFFIXES = (".csv", ".txt", ".tsv")
SUFFIX_GLOB = "*.{csv,txt,tsv}"
# date spellings tried in order when the default ISO parse fails (fixed values)
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]


def resolve_inputs(paths) -> list[str]:
    """Keep the first of equal paths, in order."""
    if isinstance(paths, str):
        paths = [paths]
    out = list(dict.fromkeys(p.rstrip("/") for p in paths if p))
    if not out:
        raise ValueError("At least one raw input is required.")
    return out


def _line_schema(n_cols: int) -> StructType:
    return StructType([StructField(f"c{i}", StringType()) for i in range(n_cols)])


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(_input, _path, _start, _line, source_file, value): the lines of the files in ``paths``, with
    the byte range they were read in and a number that ascends inside it."""
    plain = [p for p in paths if p.endswith(SUFFIXES) and not any(c in p for c in "*?[{")]
    # different files cannot overlap; a folder or a pattern may name a file again
    inputs = ([plain] if plain else []) + [[p] for p in paths if p not in set(plain)]
    frames = [spark.read.option("pathGlobFilter", SUFFIX_GLOB).option("lineSep", "\n").text(files).select(
        F.lit(i).alias("_input"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_name").alias("source_file"),
        F.monotonically_increasing_id().alias("_line"), F.regexp_replace("value", r"\r$", "").alias("value"))
        for i, files in enumerate(inputs)]
    return reduce(DataFrame.unionAll, frames)


def read_blocks(spark: SparkSession, paths, sep: str = ",", lead_rows: int = LEAD_ROWS) -> DataFrame:
    """Raw text cells of every block, plus sheet_name, source_file, row_pos (0-based
    line of the file).  A file that several inputs name is read from the first of them."""
    lines = materialize(_lines(spark, resolve_inputs(paths)))
    lines = lines.where(~F.col("source_file").startswith("~$"))
    ranges = lines.groupBy("_input", "_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    file = Window.partitionBy("_path")
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_from", F.min("_input").over(file)).where("_input = _from").withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # one row per byte range of some 100 MB: AQE broadcasts it by its measured size
    placed = lines.join(ranges.select("_input", "_path", "_start", "_first", "_before"), ["_input", "_path", "_start"])
    placed = placed.withColumn("row_pos", F.col("_before") + F.col("_line") - F.col("_first"))
    placed = placed.where((F.col("row_pos") >= lead_rows) & (F.trim("value") != ""))
    n = len(RAW_COLUMNS) + 1
    parsed = placed.select(
        "source_file", F.col("row_pos").cast("long"),
        F.from_csv(F.col("value"), _line_schema(n).simpleString(), {"sep": sep}).alias("r"))
    cols = [F.col(f"r.c{i + 1}").alias(name) for i, name in enumerate(RAW_COLUMNS)]
    sheet = F.regexp_replace(F.col("source_file"), r"\.[^.]*$", "")
    return parsed.select(*cols, sheet.alias("sheet_name"), "source_file", "row_pos")


def _date(c):
    base = parse_date(c)
    alts = [F.try_to_timestamp(F.trim(F.col(c)), F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.coalesce(base, *alts)


def type_block(raw: DataFrame) -> DataFrame:
    """Typed measures and categories; rows without a valid date dropped."""
    typed = raw.select(
        _date("date").alias("date"),
        *[normalize_numeric_text(c).alias(c) for c in NUMERIC_COLUMNS],
        *[normalize_category(c).alias(c) for c in CATEGORICAL_COLUMNS],
        "sheet_name", "source_file", "row_pos")
    return typed.where(F.col("date").isNotNull())


def load_raw_inputs(spark: SparkSession, paths, year_filter=None, sep: str = ","):
    """S2 + P3 + S5: (typed frame, one-row metadata frame).  Raises when the
    year filter leaves no row."""
    raw = read_blocks(spark, paths, sep)
    dated = raw.select("*", _date("date").alias("_d")).where(F.col("_d").isNotNull())
    years = parse_year_filter(year_filter)
    kept = filter_years(dated, years, "_d") if years else dated
    if years and kept.isEmpty():
        raise ValueError(f"No rows found for requested year(s): {', '.join(map(str, years))}")
    meta = ingest_metadata(dated, kept, "_d", "source_file")
    return type_block(kept.drop("_d")), meta


def model_source(typed: DataFrame) -> DataFrame:
    """The typed raw columns + source_file (no imputation)."""
    return typed.select(*[c for c in RAW_COLUMNS if c in typed.columns], "source_file")

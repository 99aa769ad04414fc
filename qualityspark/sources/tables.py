"""Driver tables and the ``lots`` view.

``lots`` adapts the order tables into a process-quality frame: one row per
order (a production lot) with numeric measures, a text measure with stop
tokens, gaps in one measure and a messy category.  Every query over it reads
the whole ``orders`` and ``lineitem`` tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.functions.text import normalize_category, normalize_numeric_text

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lots_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lot frame: measures as produced by the plant, before typing."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    # per-order aggregate: partial (map-side) aggregation, one shuffle on l_orderkey
    q = li.groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("iv"),
        (F.avg("l_discount") * 100).alias("dobi"),
        (F.avg("l_tax") * 100).alias("ffa"),
        (F.max("l_extendedprice") / 1000).alias("car_pv"),
        (F.avg("l_extendedprice") / 1000).alias("target"),
    )
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    j = orders.join(q, k == F.col("l_orderkey"))
    return j.select(
        k.alias("lot_id"),
        d.alias("date"),
        F.year(d).alias("yr"),
        F.col("ffa"),
        F.col("car_pv"),
        (F.col("o_totalprice") / 1000).alias("mi"),
        F.col("target"),
        F.col("o_orderstatus").alias("type"),
        F.when(k % 97 == 0, F.lit("STOP"))
        .when(k % 89 == 0, F.lit(" plant stopped "))
        .when(k % 83 == 0, F.lit(""))
        .otherwise(F.round(F.col("iv") * 100).cast("int").cast("string")).alias("iv_raw"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("dobi")).alias("dobi"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.lower(F.col("o_orderpriority")))).alias("tank_raw"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lot frame: ``iv`` parsed from text, ``tank`` normalised."""
    raw = lots_raw(spark, sf_dir)
    return raw.select(
        "lot_id", "date", "yr", "ffa", "car_pv", "mi", "target", "type",
        normalize_numeric_text("iv_raw").alias("iv"),
        "dobi",
        normalize_category("tank_raw").alias("tank"),
    )


#: years in which the plant is taken to stand still in September
STOP_YEARS = (1996, 1999)


def lots_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lots, those of September in ``STOP_YEARS`` dated 30 days later: the
    missing month that the transition feature looks for, without losing a row."""
    d = F.col("date")
    stop = F.year(d).isin(*STOP_YEARS) & (F.month(d) == 9)
    return lots(spark, sf_dir).withColumn("date", F.when(stop, d + F.expr("INTERVAL 30 DAYS")).otherwise(d))


# DuckDB / ANSI form of the same view, used by the oracle queries.
LOTS_SQL = """
q AS (
  SELECT l_orderkey, avg(l_quantity) AS iv, avg(l_discount) * 100 AS dobi,
         avg(l_tax) * 100 AS ffa, max(l_extendedprice) / 1000 AS car_pv,
         avg(l_extendedprice) / 1000 AS target
  FROM lineitem GROUP BY l_orderkey
),
lots_raw AS (
  SELECT o_orderkey AS lot_id, o_orderdate AS date, year(o_orderdate) AS yr, ffa, car_pv,
         o_totalprice / 1000 AS mi, target, o_orderstatus AS type,
         CASE WHEN o_orderkey % 97 = 0 THEN 'STOP'
              WHEN o_orderkey % 89 = 0 THEN ' plant stopped '
              WHEN o_orderkey % 83 = 0 THEN ''
              ELSE CAST(CAST(round(iv * 100) AS INTEGER) AS VARCHAR) END AS iv_raw,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE dobi END AS dobi,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(' ', lower(o_orderpriority)) END AS tank_raw
  FROM orders JOIN q ON o_orderkey = l_orderkey
),
lots AS (
  SELECT lot_id, date, yr, ffa, car_pv, mi, target, type,
         CASE WHEN upper(trim(iv_raw)) IN ('', 'STOP', 'PLANT STOPPED') THEN NULL
              ELSE TRY_CAST(trim(iv_raw) AS DOUBLE) END AS iv,
         dobi,
         CASE WHEN tank_raw IS NULL OR regexp_replace(upper(tank_raw), '\\s+', '', 'g') IN ('', 'NAN')
              THEN NULL ELSE regexp_replace(upper(tank_raw), '\\s+', '', 'g') END AS tank
  FROM lots_raw
),
lots_gap AS (
  SELECT * REPLACE (CASE WHEN year(date) IN (1996, 1999) AND month(date) = 9 THEN date + INTERVAL 30 DAY ELSE date END AS date)
  FROM lots
)"""


def with_lots(sql_body: str) -> str:
    """Prefix an oracle query with the lots CTEs."""
    body = sql_body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + LOTS_SQL.strip() + ",\n" + body[5:]
    return "WITH " + LOTS_SQL.strip() + "\n" + body

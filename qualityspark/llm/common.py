"""Shared Spark helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.session import materialize, ship_package
from qualityspark.sources.tables import table

__all__ = ["arrow_batches", "bit_column", "bit_test", "collect_bits", "components", "crc_mod", "materialize", "register",
           "split_rows", "table",
           "REGISTRY", "ORACLE"]

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker, and
    see that workers can import this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def collect_bits(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of ``2**bits`` positions (low bits of the long ``column``).
    At most ``2**bits / 64`` rows reach the driver, whatever the input: a
    proven size bound for what is sent to the executors.  Set positions of
    absent keys only cost work later; no key is ever missing."""
    pos = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (keys.where(F.col(column).isNotNull()).select(pos.alias("p"))
             .selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p & 63 AS int)) AS b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def bit_test(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the low bits of each 64-bit key are set in ``bitmap``."""
    pos = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) != 0


def bit_column(keys: DataFrame, key: Column, bits: int = 23) -> Column:
    """Whether ``key`` may be among the longs ``k`` of ``keys``: never false for
    one that is."""
    bitmap = collect_bits(keys, "k", bits)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(bit_test(bitmap, k.to_numpy(np.int64).view(np.uint64)))

    return maybe(key)


def split_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """(rows that have no key, rows that may have one with the columns of
    ``keys`` joined on).  ``keys`` has ``__id``, ``__hash`` (xxhash64 of the text) and
    more.  Rows are told apart by a bitmap of bounded size, so whole texts are
    only shuffled where a key is likely."""
    hit = bit_column(keys.select(F.xxhash64("__id", "__hash").alias("k")), F.xxhash64("__i", "__h"), bits)
    all_rows = docs.withColumn("__i", F.col(id_col).cast("long")).withColumn("__h", F.xxhash64(text_col))
    rest = all_rows.where(~hit).select(*docs.columns)
    found = all_rows.where(hit).join(keys, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    return rest, found.drop("__i", "__h")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components as (node, comp), comp being the smallest node id.

    Alternating star contraction: every round hangs each node's neighbours
    under its smallest neighbour, first the larger ones, then the smaller
    ones, until the edges are stars.  Minima are combined before the shuffle,
    rounds are written to the shared folder, nothing is collected."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = e.join(low, "u")
        if large:
            out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = (j.select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(low.select("u", F.col("m").alias("v"))))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        cur = materialize(stars(stars(cur, True), False))
        mark = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; NULL ids give NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m

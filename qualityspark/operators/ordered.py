"""Ordered-series operators without a global single-task window.

The reference treats the frame as one date-sorted series (row position, shift,
diff, rolling, interpolate).  A ``Window.orderBy`` without ``partitionBy``
would put every row into one task, so instead:

* **Buckets.**  Rows are range-partitioned by their full order (series, date,
  tie columns of any type), written once, and cut by position into buckets of at
  most ``max_bucket_rows`` rows (:mod:`qualityspark.operators.placement`).
* **Bucket table.**  One row per (series, bucket) with its row count.  What lies
  before a bucket (rows, last value) is combined in a tree: buckets inside their range
  partition, partitions among each other, so no window holds more than the
  buckets of one partition or a row per partition.
* **Local windows.**  Row number, lag and fills run inside buckets
  (``partitionBy(series, bucket)``); values that cross a bucket edge come
  from bucket summaries (fills) or from a *halo* of the previous k rows
  copied into the next buckets (lag, rolling, ACF).
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualityspark.operators.joins import join_keys
from qualityspark.operators.placement import partition_of, place
from qualityspark.session import materialize

DEFAULT_MAX_BUCKET_ROWS = 20_000
BKT = ["_b0"]


def _l(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


class Ordered:
    """A frame with a total order ``(date, *tie)`` inside optional ``series``."""

    def __init__(self, df: DataFrame, date: str, tie: Sequence[str] = (), series: Sequence[str] = (),
                 max_bucket_rows: int = DEFAULT_MAX_BUCKET_ROWS):
        self.date = date
        self.tie = _l(tie)
        self.series = _l(series)
        self.max_rows = int(max_bucket_rows)
        self.order = ([date] if date else []) + self.tie
        if not self.order:
            raise ValueError("an ordered series needs a date or an explicit order column")
        self._src = df.where(F.col(date).isNotNull()) if date else df.where(F.col(self.order[0]).isNotNull())
        self._indexed: DataFrame | None = None
        self._buckets: DataFrame | None = None

    # ------------------------------------------------------------------ buckets
    def buckets(self) -> DataFrame:
        """(series..., _b0, _bn, _first, _bord, _boff, _ntot): small per series."""
        if self._buckets is None:
            self._placed = place(self._src, self.series + self.order, self.max_rows)
            bt = self._placed.groupBy(*self.series, *BKT).agg(F.count(F.lit(1)).alias("_bn"), F.min("_mid").alias("_first"))
            bt = materialize(bt.withColumn("_part", partition_of(F.col("_b0"))))
            among = Window.partitionBy(*self.series).orderBy("_part")
            whole = Window.partitionBy(*self.series)
            before = among.rowsBetween(Window.unboundedPreceding, -1)
            parts = bt.groupBy(*self.series, "_part").agg(F.sum("_bn").alias("_pn"), F.count(F.lit(1)).alias("_pb")).select(
                *self.series, "_part", F.sum("_pn").over(before).alias("_prows"), F.sum("_pb").over(before).alias("_pbkts"),
                F.sum("_pn").over(whole).cast("long").alias("_ntot"))
            inside = Window.partitionBy(*self.series, "_part").orderBy(*BKT)
            rows_before = F.sum("_bn").over(inside.rowsBetween(Window.unboundedPreceding, -1))
            zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
            self._buckets = materialize(join_keys(bt, parts, self.series + ["_part"]).select(
                *self.series, *BKT, "_bn", "_first", "_ntot", (zero(F.col("_pbkts")) + F.row_number().over(inside)).alias("_bord"),
                (zero(F.col("_prows")) + zero(rows_before)).alias("_boff")))
        return self._buckets

    def _bucket_window(self):
        return Window.partitionBy(*self.series, *BKT).orderBy("_idx")

    def indexed(self) -> DataFrame:
        """Rows plus ``_idx`` (1-based position in its series), ``_n`` (series
        size), ``_lrn`` (position in bucket) and bucket bookkeeping."""
        if self._indexed is None:
            bt = self.buckets()
            # without a series the bucket table has a row per partition and limit
            rows = join_keys(self._placed, bt if self.series else F.broadcast(bt), self.series + BKT)
            lrn = F.col("_mid") - F.col("_first") + 1
            rows = rows.withColumn("_lrn", lrn).withColumn("_idx", F.col("_boff") + lrn).withColumn("_n", F.col("_ntot"))
            self._indexed = rows.drop("_mid", "_first")
        return self._indexed

    def _present(self, c: str):
        """The column with NaN as NULL: both mean a missing value."""
        return F.when(~F.isnan(c), F.col(c)) if dict(self._src.dtypes)[c] in ("double", "float") else F.col(c)

    # ------------------------------------------------------------------ W1 / W8
    def row_number(self, name: str = "time_trend") -> DataFrame:
        return self._clean(self.indexed().withColumn(name, F.col("_idx")))

    def blocked_split(self, train_fraction: float = 0.8, name: str = "split") -> DataFrame:
        """First floor(f*N) rows of each series are train, the rest test."""
        ix = self.indexed()
        cut = F.floor(F.col("_n") * F.lit(train_fraction))
        return self._clean(ix.withColumn(name, F.when(F.col("_idx") <= cut, F.lit("train"))
                                         .otherwise(F.lit("test"))))

    # ------------------------------------------------------------------ fills
    def _neighbours(self, cols: Sequence[str]) -> DataFrame:
        """For each col: ``_p_<c>`` / ``_n_<c>`` = struct(v, i) of the previous /
        next non-null value at or around each row, across bucket edges."""
        ix = self.indexed()
        keys = self.series + BKT
        summ_aggs = []
        for c in cols:
            val = self._present(c)
            st = F.when(val.isNotNull(), F.struct(val.alias("v"), F.col("_idx").alias("i")))
            summ_aggs.append(F.max_by(st, F.when(val.isNotNull(), F.col("_idx"))).alias(f"_bl_{c}"))
            summ_aggs.append(F.min_by(st, F.when(val.isNotNull(), F.col("_idx"))).alias(f"_bf_{c}"))
        summ = ix.groupBy(*keys).agg(F.first("_bord").alias("_bord"), *summ_aggs)
        summ = materialize(summ.withColumn("_part", partition_of(F.col("_b0"))))
        # last value before and first value after each bucket: inside its partition, else from the partitions
        # around; every frame only grows (a frame that shrinks is evaluated anew for each row)
        up, down = F.col("_b0"), F.col("_b0").desc()
        picks = [pick(k, F.when(F.col(k).isNotNull(), F.col("_bord"))).alias(k)
                 for c in cols for pick, k in ((F.max_by, f"_bl_{c}"), (F.min_by, f"_bf_{c}"))]
        parts = summ.groupBy(*self.series, "_part").agg(*picks)

        def nearest(group, order, c):
            w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return F.last(c, ignorenulls=True).over(w)

        among = parts.select(*self.series, "_part",
                             *[nearest(self.series, F.col("_part"), f"_bl_{c}").alias(f"_pp_{c}") for c in cols],
                             *[nearest(self.series, F.col("_part").desc(), f"_bf_{c}").alias(f"_pn_{c}") for c in cols])
        group = self.series + ["_part"]
        carry = join_keys(summ, among, group).select(
            *keys, *[F.coalesce(nearest(group, up, f"_bl_{c}"), F.col(f"_pp_{c}")).alias(f"_cp_{c}") for c in cols],
            *[F.coalesce(nearest(group, down, f"_bf_{c}"), F.col(f"_pn_{c}")).alias(f"_cn_{c}") for c in cols])
        j = join_keys(ix, carry, keys)
        grow = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        forward, backward = grow(F.col("_idx")), grow(F.col("_idx").desc())
        out = {}
        for c in cols:
            st = F.when(self._present(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_idx").alias("i")))
            out[f"_p_{c}"] = F.coalesce(F.last(st, ignorenulls=True).over(forward), F.col(f"_cp_{c}"))
            out[f"_n_{c}"] = F.coalesce(F.last(st, ignorenulls=True).over(backward), F.col(f"_cn_{c}"))
        return j.withColumns(out).drop(*[f"_cp_{c}" for c in cols], *[f"_cn_{c}" for c in cols])

    def interpolate(self, cols: Sequence[str]) -> DataFrame:
        """Linear interpolation by position, edges take the nearest valid
        value (pandas ``interpolate(limit_direction='both')``)."""
        return self.interpolate_and_fill(cols, [])

    def fill_forward_backward(self, cols: Sequence[str], fallback: dict | None = None) -> DataFrame:
        """Forward fill, then backward fill, then ``fallback[c]`` (a literal
        or Column, e.g. the column mode), then 'UNKNOWN'."""
        return self.interpolate_and_fill([], cols, fallback)

    def interpolate_and_fill(self, numeric: Sequence[str], filled: Sequence[str], fallback: dict | None = None) -> DataFrame:
        """W2 on ``numeric`` and W4 on ``filled`` columns in one pass over one placement."""
        numeric, filled = _l(numeric), _l(filled)
        nb = self._neighbours(numeric + filled)
        fallback = fallback or {}
        out = {}
        for c in numeric:
            p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
            slope = (n["v"] - p["v"]) / (n["i"] - p["i"])
            out[c] = (F.when(self._present(c).isNotNull(), F.col(c))
                      .when(p.isNotNull() & n.isNotNull(), slope * (F.col("_idx") - p["i"]) + p["v"])
                      .when(p.isNotNull(), p["v"])
                      .when(n.isNotNull(), n["v"]))
        for c in filled:
            fb = fallback.get(c)
            fb = F.lit(fb) if fb is not None and not hasattr(fb, "alias") else fb
            parts = [self._present(c), F.col(f"_p_{c}.v"), F.col(f"_n_{c}.v")]
            if fb is not None:
                parts.append(fb)
            parts.append(F.lit("UNKNOWN"))
            out[c] = F.coalesce(*parts)
        res = nb.withColumns(out)
        return self._clean(res.drop(*[f"_{side}_{c}" for c in numeric + filled for side in "pn"]))

    # ------------------------------------------------------------------ halo
    def with_halo(self, k: int, cols: Sequence[str]) -> DataFrame:
        """Rows of every bucket plus copies (``_halo`` = 1) of the k rows that
        precede the bucket, so lag/rolling windows of depth <= k are exact when
        run inside buckets."""
        ix = self.indexed()
        keys = self.series + BKT
        keep = list(dict.fromkeys(self.series + BKT + self.order + _l(cols) + ["_idx", "_n", "_bord"]))
        base = ix.withColumn("_halo", F.lit(0))
        tails = ix.where(F.col("_lrn") > F.col("_bn") - k).select(
            *keep, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_step"))
        tails = tails.withColumn("_tord", F.col("_bord") + F.col("_step")).drop(*BKT, "_bord", "_step")
        bt = self.buckets().select(*self.series, *BKT, F.col("_bord").alias("_tord"))
        halo = join_keys(tails, bt, self.series + ["_tord"])
        wt = Window.partitionBy(*keys).orderBy(F.col("_idx").desc())
        halo = halo.withColumn("_r", F.row_number().over(wt)).where(F.col("_r") <= k) \
                   .drop("_r").withColumnRenamed("_tord", "_bord").withColumn("_halo", F.lit(1))
        return base.unionByName(halo.select(*keep, "_halo"), allowMissingColumns=True)

    def halo_window(self):
        return Window.partitionBy(*self.series, *BKT).orderBy("_idx")

    def lag_features(self, target: str, max_gap_days: int = 2, prefix: str | None = None,
                     roll: int = 3, roll_min: int = 2) -> DataFrame:
        """``<t>_lag1`` (NULL when the gap to the previous row exceeds
        ``max_gap_days``), ``<t>_roll3`` (mean of the last ``roll`` lag values,
        at least ``roll_min`` present) and ``date_diff_days``."""
        prefix = prefix or target
        h = self.with_halo(roll, [target])
        w = self.halo_window()
        if self.date is None:      # W5b: plain previous row, no gap rule
            h = h.withColumn("_prev_date", F.lit(None).cast("timestamp")) \
                 .withColumn("_prev_y", F.lag(self._present(target)).over(w))
            diff = F.lit(None).cast("long")
        else:
            h = h.withColumn("_prev_date", F.lag(self.date).over(w)) \
                 .withColumn("_prev_y", F.lag(self._present(target)).over(w))
            diff = F.expr(f"timestampdiff(DAY, _prev_date, `{self.date}`)")
        lag1 = F.when(diff > max_gap_days, F.lit(None).cast("double")).otherwise(F.col("_prev_y"))
        h = h.withColumn("date_diff_days", diff).withColumn(f"{prefix}_lag1", lag1) \
             .drop("_prev_date", "_prev_y")
        wr = w.rowsBetween(-(roll - 1), 0)
        lagc = F.col(f"{prefix}_lag1")
        h = h.withColumn(f"{prefix}_roll{roll}", F.when(F.count(lagc).over(wr) >= roll_min, F.avg(lagc).over(wr)))
        return self._clean(h.where(F.col("_halo") == 0))

    def acf(self, value: str, nlags: int = 40, alpha: float = 0.05) -> DataFrame:
        """Biased autocorrelation r_0..r_nlags of ``value`` (rows with NULL
        value dropped first) with Bartlett standard errors."""
        src = Ordered(self._src.where(self._present(value).isNotNull()), self.date, self.tie, self.series,
                      self.max_rows)
        h = src.with_halo(nlags, [value])
        mean = src._src.groupBy(*self.series).agg(F.avg(value).alias("_mu"), F.count(F.lit(1)).alias("_cnt"))
        h = join_keys(h, mean, self.series) if self.series else h.crossJoin(F.broadcast(mean))
        w = src.halo_window()
        d = F.col(value) - F.col("_mu")
        prods = [d * (F.lag(F.col(value), k).over(w) - F.col("_mu")) if k else d * d
                 for k in range(nlags + 1)]
        h = h.select(*self.series, "_halo", "_cnt", *[p.alias(f"_c{k}") for k, p in enumerate(prods)])
        h = h.where(F.col("_halo") == 0)
        sums = h.groupBy(*self.series).agg(F.first("_cnt").alias("n"),
                                            *[F.sum(f"_c{k}").alias(f"_c{k}") for k in range(nlags + 1)])
        long = sums.select(*self.series, "n", F.explode(F.array(*[
            F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("c")) for k in range(nlags + 1)
        ])).alias("s")).select(*self.series, "n", "s.lag", "s.c")
        wl = Window.partitionBy(*self.series).orderBy("lag")
        c0 = F.first("c").over(wl.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        long = long.withColumn("acf", F.col("c") / c0)
        cum = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(
            wl.rowsBetween(Window.unboundedPreceding, -1))
        var = (F.when(F.col("lag") == 0, F.lit(0.0))
               .otherwise((F.lit(1.0) + 2 * F.coalesce(cum, F.lit(0.0))) / F.col("n")))
        z = NormalDist().inv_cdf(1 - alpha / 2)
        se = F.sqrt(var)
        return long.select(*self.series, F.col("lag").cast("int").alias("lag"), "acf", se.alias("se"),
                           (F.col("acf") - z * se).alias("lower"), (F.col("acf") + z * se).alias("upper"))

    # ------------------------------------------------------------------ helpers
    _INTERNAL = set(BKT) | {"_bn", "_bord", "_boff", "_ntot", "_lrn", "_halo", "_tord"}

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c in self._INTERNAL])


def mode_of(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """A5: most frequent non-null value, the smallest on a tie.  Counts are
    pre-aggregated per value, so the pick runs over the (small) value table."""
    keys = _l(keys)
    vc = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    pick = F.min_by(F.col(col), F.struct((-F.col("_c")).alias("c"), F.col(col).alias("v")))
    if keys:
        return vc.groupBy(*keys).agg(pick.alias(f"{col}_mode"))
    return vc.agg(pick.alias(f"{col}_mode"))

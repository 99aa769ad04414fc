"""Exact ranks and quantiles without putting a group into one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a ``Window.partitionBy(group).orderBy(value)`` sorts a
whole group in one task.  A single month or feature can hold a third of all
rows, so neither holds at scale.  Instead:

* Ranks: ``value_counts`` (map-side combined, so a value repeated a billion
  times is one row) is placed in order and cut into bounded bins
  (:mod:`qualityspark.operators.placement`); the small bin table gives each bin its
  offset, a window inside a bin each value its running count.
* Quantiles: ``percentile_approx`` brackets every wanted rank between two values
  (its rank error is bounded by n / accuracy).  One pass counts what lies below each
  bracket and keeps only the values inside, among which the exact rank is picked.
  Nothing else is shuffled.  A bracket that missed its rank would raise an
  error, never give a wrong value.  ``values_of_ranks`` does so for ranks that differ by group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityspark.operators.joins import join_keys
from qualityspark.operators.placement import place
from qualityspark.session import materialize

DEFAULT_MAX_BIN = 200_000
#: rank error of a bracket's ends is n / ACCURACY; brackets reach 4 times as far
ACCURACY = 10_000


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def value_counts(df: DataFrame, keys, value: str, weight: str | None = None) -> DataFrame:
    """(keys..., value, _w) for non-null, non-NaN values."""
    keys = _keys(keys)
    v = F.col(value)
    src = df.where(v.isNotNull() & ~F.isnan(v)) if dict(df.dtypes)[value] in ("double", "float") \
        else df.where(v.isNotNull())
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    return src.groupBy(*keys, value).agg(w.cast("long").alias("_w"))


def cumulative(freq: DataFrame, keys, value: str, max_bin: int = DEFAULT_MAX_BIN) -> DataFrame:
    """Add ``_before`` (weight of strictly smaller values in the group), ``_n``
    (group total) and the bin columns to a value-count frame."""
    keys = _keys(keys)
    placed = place(freq, keys + [value], max_bin, "_b1")
    w = Window.partitionBy(*keys).orderBy("_b1")
    bins = placed.groupBy(*keys, "_b1").agg(F.sum("_w").alias("_bw")).select(
        *keys, "_b1", "_bw",
        F.coalesce(F.sum("_bw").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_boff"),
        F.sum("_bw").over(Window.partitionBy(*keys)).alias("_n"))
    inside = Window.partitionBy(*keys, "_b1").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    return join_keys(placed, bins, keys + ["_b1"]).withColumn(
        "_before", F.col("_boff") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).drop("_mid")


def bin_table(cum: DataFrame, keys) -> DataFrame:
    keys = _keys(keys)
    return cum.select(*keys, "_b1", "_bw", "_boff", "_n").dropDuplicates(keys + ["_b1"])


def average_ranks(df: DataFrame, keys, value: str, max_bin: int = DEFAULT_MAX_BIN) -> DataFrame:
    """(keys..., value, _w, _rank, _n): 1-based average rank of each distinct value."""
    keys = _keys(keys)
    if not keys:
        df, keys = df.withColumn("_g", F.lit(0)), ["_g"]
    return weighted_ranks(value_counts(df, keys, value), keys, value, max_bin)


def weighted_ranks(freq: DataFrame, keys, value: str, max_bin: int = DEFAULT_MAX_BIN) -> DataFrame:
    """:func:`average_ranks` from value counts (keys..., value, _w)."""
    keys = _keys(keys)
    cum = cumulative(freq, keys, value, max_bin)
    return cum.select(*keys, value, "_w", "_n",
                      (F.col("_before") + (F.col("_w") + 1) / 2.0).alias("_rank"))


def value_at_rank(cum: DataFrame, keys, value: str, targets: DataFrame) -> DataFrame:
    """For each target row (keys..., _r, ...) return the ``value`` holding the
    0-based rank ``_r`` in its group.  ``cum`` comes from :func:`cumulative`.
    The rank is located in the bin table first, then inside one bin (an
    equi-join on the bin key, so no group is gathered in one task)."""
    keys = _keys(keys)
    bins = bin_table(cum, keys).drop("_n")
    located = join_keys(targets, bins, keys).where(
        (F.col("_boff") <= F.col("_r")) & (F.col("_r") < F.col("_boff") + F.col("_bw"))
    ).drop("_boff", "_bw")
    return join_keys(located, cum.select(*keys, "_b1", value, "_w", "_before"), keys + ["_b1"]).where(
        (F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_w"))
    ).drop("_b1", "_w", "_before")


#: places of the value grid from which a rank's bracket is taken; 3 / GRID of a group lie in a bracket
GRID = 1000


def values_of_ranks(df: DataFrame, keys, value: str, targets: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """(keys..., _r, value): the non-null numeric ``value`` that holds the 0-based rank ``_r`` in its group,
    for each (keys..., _r) in ``targets`` (a few ranks a group; ranks outside the group give no row).  A grid of approximate
    quantiles brackets each rank, one pass counts what lies below the brackets, and only the values inside
    are shuffled and ranked.  Brackets compare values as doubles, which keeps their order."""
    keys = _keys(keys)
    v, x = F.col(value), F.col(value).cast("double")
    src = df.select(*keys, value).where(v.isNotNull())
    rough = src.groupBy(*keys).agg(F.percentile_approx(x, [i / GRID for i in range(GRID + 1)], accuracy).alias("_g"),
                                   F.min(x).alias("_min"), F.max(x).alias("_max"), F.count(F.lit(1)).alias("_n"))
    wanted = join_keys(rough, targets.select(*keys, "_r").distinct(), keys).where("_r >= 0 AND _r < _n")
    at = F.floor(F.col("_r") * F.lit(GRID) / F.col("_n")).cast("int")
    few = F.col("_n") <= F.lit(4 * accuracy)
    lo = F.when(few | (at < 2), F.col("_min")).otherwise(F.get("_g", at - 1))
    hi = F.when(few | (at + 2 >= GRID), F.col("_max")).otherwise(F.get("_g", at + 2))
    one = F.struct(F.col("_r").cast("long").alias("r"), lo.alias("lo"), hi.alias("hi"))
    brackets = materialize(wanted.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_br")))   # one row a group
    j = join_keys(src, brackets, keys)
    # ends ascend with the rank: a value below the i-th is below all later ones
    under = F.size(F.filter("_br", lambda b: x < b["lo"])).alias("_cell")
    cells = join_keys(j.groupBy(*keys, under).agg(F.count(F.lit(1)).alias("_c")), brackets, keys)
    below = cells.select(*keys, "_c", "_cell", F.size("_br").alias("_many"), F.posexplode("_br").alias("_i", "_b")).groupBy(
        *keys, F.col("_b.r").alias("_r")).agg(
            F.sum(F.when(F.col("_cell") >= F.col("_many") - F.col("_i"), F.col("_c")).otherwise(0)).alias("_under"))
    hit = F.filter("_br", lambda b: (x >= b["lo"]) & (x <= b["hi"]))
    inside = j.select(*keys, value, F.explode(F.transform(hit, lambda b: b["r"])).alias("_r")).groupBy(*keys, "_r", value).agg(
        F.count(F.lit(1)).alias("_w"))
    run = Window.partitionBy(*keys, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_keys(inside.withColumn("_upto", F.sum("_w").over(run)), below, keys + ["_r"])
    upto = F.col("_under") + F.col("_upto")
    got = ranked.groupBy(*keys, "_r").agg(
        F.max(F.when((upto - F.col("_w") <= F.col("_r")) & (F.col("_r") < upto), v)).alias(value))
    lost = F.raise_error("a rank bracket missed its rank").cast(df.schema[value].dataType)
    return got.withColumn(value, F.when(v.isNull(), lost).otherwise(v))


SELECT_BITS = 16


def values_at_ranks(df: DataFrame, key: Column, ranks: Callable[[int], Sequence[int]]) -> tuple[int, list[int]]:
    """(number of rows, the 0-based rank's value of the long ``key`` for each of ``ranks(rows)``;
    None outside the rows).  Histogram selection: a pass counts the keys by their top 16 bits, the
    next by the next 16 bits of the keys that begin like a wanted one, until a prefix holds one value.
    Counts are combined before the shuffle; a pass gives at most ranks x 2**16 rows, of which one a
    rank reaches the driver.  Rows never move."""
    keyed = df.select(key.cast("long").alias("_key")).where("_key IS NOT NULL")
    n, wanted, found = None, None, {}
    for shift in range(64 - SELECT_BITS, -1, -SELECT_BITS):
        prefix = F.shiftright("_key", shift + SELECT_BITS) if wanted is not None else F.lit(0).cast("long")
        rows = keyed.withColumn("_prefix", prefix)
        if wanted is not None:
            rows = rows.where(F.col("_prefix").isin(sorted({p for p, _ in wanted.values()})))
        bins = rows.groupBy("_prefix", F.shiftright("_key", shift).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
        run = Window.partitionBy("_prefix").orderBy("_bin")                     # at most 2**16 rows
        bins = materialize(bins.withColumn("_upto", F.sum("_c").over(run)))
        if wanted is None:
            n = bins.agg(F.max("_upto")).first()[0] or 0
            wanted = {r: (0, r) for r in ranks(n) if 0 <= r < n}
        hit = F.lit(False)
        for p, r in set(wanted.values()):
            hit = hit | ((F.col("_prefix") == p) & (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r))
        got = bins.where(hit).collect() if wanted else []                        # one row a rank
        left = {}
        for rank, (p, r) in wanted.items():
            b = next(b for b in got if b["_prefix"] == p and b["_upto"] - b["_c"] <= r < b["_upto"])
            if b["_lo"] == b["_hi"]:
                found[rank] = b["_lo"]
            else:
                left[rank] = (b["_bin"], r - (b["_upto"] - b["_c"]))
        wanted = left
        if not wanted:
            break
    return n, [found.get(r) for r in ranks(n)]


def quantiles(df: DataFrame, keys, value: str, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles (same rule as pandas ``quantile`` and
    DuckDB ``quantile_cont``).  Returns (keys..., prob, quantile, n)."""
    keys = _keys(keys)
    if not keys:
        return quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value, probs, accuracy).drop("_g")
    ps = [float(p) for p in probs]
    reach = 4.0 / accuracy
    v = F.col(value)
    src = df.select(*keys, value).where(v.isNotNull())
    if dict(df.dtypes)[value] in ("double", "float"):
        src = src.where(~F.isnan(value))
    ends = [max(0.0, p - reach) for p in ps] + [min(1.0, p + reach) for p in ps]
    rough = src.groupBy(*keys).agg(F.percentile_approx(v, ends, accuracy).alias("_e"), F.min(v).alias("_min"),
                                   F.max(v).alias("_max"), F.count(F.lit(1)).alias("_n"))
    # the two ranks around p (n - 1) and a value at or below, at or above them
    lows = [F.col("_min") if ends[i] == 0 else F.col("_e")[i] for i in range(len(ps))]
    highs = [F.col("_max") if ends[len(ps) + i] == 1 else F.col("_e")[len(ps) + i] for i in range(len(ps))]
    # few values: a rank's neighbour may lie beyond the rounded end
    few = F.col("_n") <= F.lit(4 * accuracy)
    bracket = F.array(*[F.struct(F.lit(i).alias("_i"), F.when(few, F.col("_min")).otherwise(lo).alias("_lo"),
                                 F.when(few, F.col("_max")).otherwise(hi).alias("_hi"))
                        for i, (lo, hi) in enumerate(zip(lows, highs))])
    brackets = materialize(rough.select(*keys, "_n", bracket.alias("_br")))      # one row per group
    j = join_keys(src, brackets, keys)
    below = j.groupBy(*keys).agg(*[F.count_if(v < F.col("_br")[i]["_lo"]).alias(f"_u{i}") for i in range(len(ps))])
    below = below.select(*keys, F.posexplode(F.array(*[f"_u{i}" for i in range(len(ps))])).alias("_i", "_under"))
    hit = F.filter("_br", lambda b: (v >= b["_lo"]) & (v <= b["_hi"]))
    inside = j.select(*keys, "_n", value, F.explode(F.transform(hit, lambda b: b["_i"])).alias("_i")) \
        .groupBy(*keys, "_i", value).agg(F.count(F.lit(1)).alias("_w"), F.first("_n").alias("_n"))
    run = Window.partitionBy(*keys, "_i").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = join_keys(inside.withColumn("_upto", F.sum("_w").over(run)), below, keys + ["_i"])
    prob = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_i") + 1)
    pos = prob * (F.col("_n") - 1)
    ranked = inside.withColumns({"prob": prob, "_lr": F.floor(pos), "_hr": F.ceil(pos), "_frac": pos - F.floor(pos),
                                 "_to": F.col("_under") + F.col("_upto")})
    at = lambda r: F.max(F.when((F.col("_to") - F.col("_w") <= F.col(r)) & (F.col(r) < F.col("_to")), v))
    got = ranked.groupBy(*keys, "prob").agg(F.first("_n").alias("n"), F.first("_frac").alias("_frac"),
                                            at("_lr").alias("_lo"), at("_hr").alias("_hi"))
    q = F.when(F.col("_frac") == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    lost = F.raise_error("a quantile bracket missed its rank").cast("double")
    return got.select(*keys, "prob", F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), lost)
                      .otherwise(q.cast("double")).alias("quantile"), F.col("n").cast("long").alias("n"))


def quantiles_wide(df: DataFrame, keys, value: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Quantiles as named columns, e.g. ``{"q1": .25, "q3": .75}``."""
    keys = _keys(keys)
    long = quantiles(df, keys, value, list(probs.values()), accuracy)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name)
            for name, p in probs.items()]
    if keys:
        return long.groupBy(*keys).agg(*aggs, F.max("n").alias("n"))
    return long.agg(*aggs, F.max("n").alias("n"))


#: distinct values in a bin, and bins a key at most (bins grow with the data beyond)
PREFIX_BIN = 2048
PREFIX_BINS = 4096


def prefix_quantiles(df: DataFrame, period: str, value: str, targets: DataFrame, probs: Sequence[float],
                     max_bin: int = PREFIX_BIN, keys=()) -> DataFrame:
    """Exact quantiles of ``value`` (per ``keys``) over all rows with ``period < t`` for every
    ``t`` in ``targets`` (column ``period``, and some of the keys if they differ by key) -
    expanding windows.

    Two-dimensional prefix counts: distinct values are cut into bins, rows counted per (period, bin), and
    running sums over the periods of a bin give the counts before every target; those over the
    bins of a target locate each rank in one bin, whose values are ranked.  The targets enter the
    running sums as rows of weight 0, so no period is compared with another by a join.
    Returns (keys..., period, prob, quantile, n, lo, hi), lo and hi being the two values around."""
    keys = _keys(keys)
    freq = materialize(value_counts(df, keys + [period], value))
    distinct = freq.select(*keys, value).distinct()
    size = max(max_bin, -(-distinct.count() // PREFIX_BINS))
    vbin = place(distinct, keys + [value], size, "_b1").select(*keys, value, "_b1")     # distinct value -> bin
    fb = materialize(join_keys(freq, vbin, keys + [value]))
    cells = fb.groupBy(*keys, "_b1", period).agg(F.sum("_w").alias("_c")).withColumn("_t", F.lit(1))
    shared = [c for c in targets.columns if c in keys]
    wanted = targets.select(*shared, period).distinct()
    bins = cells.select(*keys, "_b1").distinct()
    marks = (bins.join(wanted, shared) if shared else bins.crossJoin(F.broadcast(wanted)))   # the prefix table's cells
    run = Window.partitionBy(*keys, "_b1").orderBy(period, "_t").rowsBetween(Window.unboundedPreceding, 0)
    both = cells.unionByName(marks.withColumn("_c", F.lit(0).cast("long")).withColumn("_t", F.lit(0)))
    pre = both.withColumn("_bw", F.sum("_c").over(run)).where("_t = 0").where("_bw > 0").drop("_c", "_t")
    over = Window.partitionBy(*keys, period).orderBy("_b1")
    pre = materialize(pre.withColumn("_boff", F.sum("_bw").over(over) - F.col("_bw"))
                      .withColumn("_n", F.sum("_bw").over(Window.partitionBy(*keys, period))))
    pos = F.col("prob") * (F.col("_n") - 1)
    ranked = pre.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    ranked = ranked.withColumn("_r", F.when(F.col("_side") == 0, F.floor(pos)).otherwise(F.ceil(pos)).cast("long"))
    at = ranked.where((F.col("_boff") <= F.col("_r")) & (F.col("_r") < F.col("_boff") + F.col("_bw"))).select(
        *keys, "_b1", F.col(period).alias("_t"), "prob", "_side", "_n", (pos - F.floor(pos)).alias("_frac"), (F.col("_r") - F.col("_boff")).alias("_rr"))
    # the values of the bin that holds the rank, counted over the earlier periods
    near = join_keys(fb, at, keys + ["_b1"]).where(F.col(period) < F.col("_t"))
    near = near.groupBy(*keys, "_t", "prob", "_side", "_rr", "_n", "_frac", value).agg(F.sum("_w").alias("_w"))
    upto = Window.partitionBy(*keys, "_t", "prob", "_side").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_upto", F.sum("_w").over(upto)).where(
        (F.col("_upto") - F.col("_w") <= F.col("_rr")) & (F.col("_rr") < F.col("_upto")))
    side = lambda k: F.max(F.when(F.col("_side") == k, F.col(value)))
    wide = near.groupBy(*keys, "_t", "prob").agg(F.first("_n").alias("n"), F.first("_frac").alias("_frac"), side(0).alias("lo"), side(1).alias("hi"))
    q = F.when(F.col("_frac") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_frac"))
    return wide.select(*keys, F.col("_t").alias(period), "prob", q.cast("double").alias("quantile"), F.col("n").cast("long").alias("n"), "lo", "hi")

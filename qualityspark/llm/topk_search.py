"""Exact top-k inner products by distributed histogram selection.

Vectors become whole numbers (``floor(scale * x)``), so all scores are exact.
Every query is scored against every candidate in tiles of a block of queries
and a block of candidates.  No score is kept: a pass only counts the scores of
each query in the bins of its current range.  The bin that holds the k-th
highest score becomes the next range, until a bin is one value; that value is the
query's threshold.  A last pass keeps the scores above the threshold and, of those
equal to it, as many of the smallest ids as are missing.

Scale: the score matrix is never stored or shuffled.  A task reports, per query,
only its bins down to its own k-th score (lower ones cannot hold the global one), and in
the last pass at most k rows, so copies of one vector do not flood a task.  Blocks
of queries meet blocks of candidates through a join on the block number; a tile
has a fixed size, whatever the input.

Defined results: vectors that are NULL or hold a NULL or non-finite component take no
part; a vector is compared with those of its own length; rows with the query's
id are not its candidates; of rows with the same id and the same vector as query one
is kept; a NULL id takes no part.  Fewer than k candidates are all returned.
A vector with a component of more than 2**30 / sqrt(length) is large: its scores may leave a long, so pairs with
one are scored in Python integers in a pass of their own (the best k a tile), ranked exactly, and
merged; a score beyond a long is shown as the nearest long.  A component that leaves the
doubles when it is scaled counts as not finite.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from qualityspark.llm import common, exact

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 2048
BINS = 512


def _whole(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, large) of the rows that take part."""
    ok = rows.where(exact.usable(F.col("embedding"), scale) & F.col("vec_id").isNotNull())
    ok = ok.select("vec_id", exact.whole(F.col("embedding"), scale).alias("v"))
    limit = F.lit(float(1 << 30)) / F.sqrt(F.greatest(F.size("v"), F.lit(1)))
    return ok.withColumn("large", F.exists("v", lambda c: F.abs(c) > limit))


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """One row per block: dim, number, ids and the matrix as bytes."""
    def build(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, mats = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                 pa.array([np.concatenate(mats).tobytes()], pa.binary())], names=["dim", f"{prefix}_ids", f"{prefix}_mat"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.diff(off)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                mat = flat[(off[at][:, None] + np.arange(d)[None]).ravel()].reshape(len(at), d) if d else np.zeros((len(at), 0))
                for i in range(0, len(at), size):
                    held.setdefault(int(d), []).append((ids[at[i:i + size]], mat[i:i + size]))
                    if sum(len(x[0]) for x in held[int(d)]) >= size:
                        yield out(int(d))
        for d in list(held):
            yield out(d)

    return rows.mapInArrow(build, f"dim int, {prefix}_ids binary, {prefix}_mat binary")


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, exact score matrix)."""
    q, c = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    a = np.frombuffer(row["q_mat"], np.float64).reshape(len(q), row["dim"])
    b = np.frombuffer(row["c_mat"], np.float64).reshape(len(c), row["dim"])
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, row["dim"])
    if top < 2 ** 53:  # every partial sum is exact in a double
        return q, c, (a @ b.T).astype(np.int64)
    return q, c, a.astype(np.int64) @ b.astype(np.int64).T


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by
    ``every`` as queries against all rows."""
    spark = rows.sparkSession
    common.arrow_batches(spark)
    vectors = common.materialize(_whole(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale))
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    # a query row's own key: the same id may stand for several vectors
    all_queries = common.materialize(queries.withColumn("qid", F.monotonically_increasing_id()))
    ids = all_queries.select("qid", F.col("vec_id").alias("query_id"))
    kept = _ordinary(all_queries.where("NOT large"), vectors.where("NOT large"), k).withColumn("big", F.lit(None).cast("string"))
    if not vectors.where("large").isEmpty():
        kept = kept.unionByName(_large(all_queries, vectors, k))
    common.arrow_batches(spark)
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("big"), "vec_id")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(ids, "qid")
            .select("query_id", "rank", "vec_id", "score"))


def _large(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best k of every tile of pairs with a large vector on either side."""
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tile_rows(batches):
        for row in _rows(batches):
            q, own, c = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "own", "c_ids"))
            a, b = exact.pair(np.frombuffer(row["q_mat"], np.float64).reshape(len(q), row["dim"]),
                              np.frombuffer(row["c_mat"], np.float64).reshape(len(c), row["dim"]))
            out = []
            for i in range(len(q)):
                score = b @ a[i] if row["dim"] else np.zeros(len(c))
                best = sorted({(-int(s), int(x)) for s, x in zip(score, c) if x != own[i]})[:k]
                out += [(int(q[i]), x, -s) for s, x in best]
            shown, big = exact.shown([r[2] for r in out])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                              pa.array(shown, pa.int64()), pa.array(big, pa.string())], names=["qid", "vec_id", "score", "big"])

    def pairs(q, c):
        own = q.select("qid", "vec_id")
        qb = _blocks(q.select("qid", "v"), 64, "q").withColumn("b", F.monotonically_increasing_id())
        qb = common.materialize(qb)
        of = _members(qb.withColumnRenamed("b", "qblock")).join(own, "qid").groupBy("qblock").agg(
            F.map_from_entries(F.collect_list(F.struct("qid", "vec_id"))).alias("m"))  # a block's queries
        cb = common.materialize(_blocks(c.select("vec_id", "v"), 256, "c").withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")))

        def with_own(batches):
            for row in _rows(batches):
                m = dict(row["m"])
                row["own"] = np.array([m[x] for x in np.frombuffer(row["q_ids"], np.int64).tolist()], np.int64).tobytes()
                yield pa.RecordBatch.from_pylist([{x: row[x] for x in ("dim", "q_ids", "q_mat", "own")}],
                                                 schema=pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q_mat", pa.binary()), ("own", pa.binary())]))

        known = qb.join(of, F.col("b") == F.col("qblock")).select("dim", "q_ids", "q_mat", "m")
        known = common.materialize(known.mapInArrow(with_own, "dim int, q_ids binary, q_mat binary, own binary"))
        known = known.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return known.join(cb, ["g", "dim"]).drop("g").mapInArrow(tile_rows, "qid long, vec_id long, score long, big string")

    got = pairs(queries, vectors.where("large")).unionByName(pairs(queries.where("large"), vectors.where("NOT large")))
    return common.materialize(got)


def _ordinary(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score): the best k of every query, none of the vectors being large."""
    spark = vectors.sparkSession
    common.arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    qb = common.materialize(_blocks(queries.select("qid", "v").coalesce(max(1, parts // 4)), QUERY_BLOCK, "q")
                            .withColumn("qblock", F.monotonically_increasing_id()))
    cb = common.materialize(_blocks(vectors.select("vec_id", "v"), CANDIDATE_BLOCK, "c").withColumn("cblock", F.monotonically_increasing_id()))
    common.arrow_batches(spark, 4)  # a row is a tile from here on
    # tiles: every query block with every candidate block of its dimension
    pairs = common.materialize(qb.select("dim", "qblock").join(cb.select("dim", "cblock"), "dim"))

    def tiles(state: DataFrame | None) -> DataFrame:
        """Tiles with the ids and, from the second pass on, the ranges of their queries."""
        q = qb.join(state, "qblock") if state is not None else qb
        return pairs.drop("dim").join(q, "qblock").join(cb.drop("dim"), "cblock").repartition(parts, "qblock", "cblock")

    # range of all scores: |q| |c| bounds them; one small row
    norm = vectors.select(F.aggregate("v", F.lit(0.0), lambda s, c: s + F.abs(c)).alias("one"),
                          F.array_max(F.transform("v", F.abs)).alias("top")).agg(F.max("one").alias("one"), F.max("top").alias("top")).first()
    reach = int((norm["one"] or 0) * (norm["top"] or 0)) + 1

    own = (queries.select("qid", "vec_id").join(_members(qb), "qid").groupBy("qblock")
           .agg(F.sort_array(F.collect_list(F.struct("qid", "vec_id"))).alias("m")))
    own = common.materialize(own)

    width, low = 1, -reach
    while width * BINS < 2 * reach + 1:
        width *= BINS
    found = common.materialize(queries.select("qid", F.lit(low).cast("long").alias("low"), F.lit(0).cast("long").alias("above")))
    while True:
        state = _state(own, found)
        counted = _count(tiles(state), width, k).groupBy("qid", "low", "above", "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy("qid").orderBy(F.desc("bin"))
        up = counted.withColumn("upto", F.sum("n").over(w) + F.col("above"))
        # the first bin that reaches k; with fewer candidates the lowest one
        hit = (up.groupBy("qid").agg(F.max(F.when(F.col("upto") >= k, F.struct("bin", "low", "upto", "n"))).alias("x"),
                                     F.min(F.struct("bin", "low", "upto", "n")).alias("y"))
               .select("qid", F.coalesce("x", "y").alias("x")))
        found = common.materialize(hit.select("qid", (F.col("x.low") + F.col("x.bin") * width).alias("low"),
                                              (F.col("x.upto") - F.col("x.n")).alias("above")))
        if width == 1:
            break
        width //= BINS

    return common.materialize(_keep(tiles(_state(own, found)), k))


def _members(qb: DataFrame) -> DataFrame:
    def scan(batches):
        for row in _rows(batches):
            q = np.frombuffer(row["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), row["qblock"]))], names=["qid", "qblock"])
    return qb.select("q_ids", "qblock").mapInArrow(scan, "qid long, qblock long")


def _state(own: DataFrame, found: DataFrame) -> DataFrame:
    """Per query block: ids, lower ends and counts above, each sorted by query."""
    one = own.select("qblock", F.explode("m").alias("m")).select("qblock", "m.*").join(found, "qid", "left")
    return one.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct(
        "qid", "vec_id", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("above", F.lit(0)).alias("above")))).alias("m"))


def _open(row):
    """A tile: query keys, range starts, counts above, candidate ids, scores, and
    which candidates are not the query's own rows."""
    q, c, s = _scores(row)
    m = {x["qid"]: x for x in row["m"]}
    own, low, above = (np.array([m[i][f] for i in q.tolist()], np.int64) for f in ("vec_id", "low", "above"))
    return q, low, above, c, s, c[None, :] != own[:, None]


def _count(tiles: DataFrame, width: int, k: int) -> DataFrame:
    def scan(batches):
        total: dict[tuple, dict] = {}
        for row in _rows(batches):
            q, low, above, c, s, other = _open(row)
            b = (s - low[:, None]) // width
            inside = other & (b >= 0) & (b < BINS)
            for i in range(len(q)):
                x = b[i][inside[i]]
                if len(x) > k:  # bins below the tile's own k-th score cannot hold the global one
                    x = x[x >= np.partition(x, len(x) - k)[len(x) - k]]
                t = total.setdefault((int(q[i]), int(low[i]), int(above[i])), {})
                u, n = np.unique(x, return_counts=True)
                for a, m in zip(u.tolist(), n.tolist()):
                    t[a] = t.get(a, 0) + m
                if len(t) > 4 * k:
                    _trim(t, k)
        out = []
        for key, t in total.items():
            _trim(t, k)
            out += [(*key, b, n) for b, n in t.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)],
                                         names=["qid", "low", "above", "bin", "n"])

    return tiles.mapInArrow(scan, "qid long, low long, above long, bin long, n long")


def _trim(t: dict, k: int) -> None:
    """Drop the bins below the one that reaches k from above."""
    seen = 0
    for b in sorted(t, reverse=True):
        if seen >= k:
            del t[b]
        else:
            seen += t[b]


def _keep(tiles: DataFrame, k: int) -> DataFrame:
    """Scores above the threshold ``low`` and, per task, the smallest ids at it."""
    def scan(batches):
        best: dict[int, list] = {}
        for row in _rows(batches):
            q, low, above, c, s, other = _open(row)
            for i in range(len(q)):
                at = np.flatnonzero(other[i] & (s[i] >= low[i]))
                if len(at):
                    o = at[np.lexsort((c[at], -s[i][at]))[:k]]
                    have = best.setdefault(int(q[i]), []) + list(zip((-s[i][o]).tolist(), c[o].tolist()))
                    best[int(q[i])] = sorted(have)[:k]
        out = [(q, c, -s) for q, rows in best.items() for s, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["qid", "vec_id", "score"])

    return tiles.mapInArrow(scan, "qid long, vec_id long, score long")


ORACLE_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


@common.register("op5_exact_topk", ORACLE_TOPK)
def op5(spark, sf):
    return top_k(common.table(spark, sf, "embeddings"))

"""Hard-negative mining with STR-packed R-trees.

Vectors become whole numbers (``floor(scale * x)``), so all scores are exact.  An
anchor's positives are its ``positives`` best other rows of the same label.  For every
(anchor, positive) the rows of other labels whose score lies in
``[low, high]`` percent of the positive's are negatives; the best ``negatives`` stay.

Rows are range-partitioned by their first coordinate and packed into R-trees
of ``TREE`` rows: sort-tile-recursive cuts the rows along the widest coordinates into leaves of
``LEAF`` rows, and ``FAN`` boxes make a box of the next level.  A box gives an interval
per coordinate, and so bounds of its inner products with an anchor.  The search takes
boxes from a queue in order of their upper bound; it leaves out boxes that no
score window touches and stops below the k-th score found (strictly: ties by id need
equal bounds to be opened).

Scale: trees are dealt once over the tasks by a group number and the blocks of anchors visit
every group, so trees are not copied per block, and a tile (block, tree) has a fixed
size.  A tile reports at most k rows a query.  A first pass over one tree an anchor gives
it a k-th score that no better list can undercut; later tiles report nothing below
it.  The stated query set (ids divisible by ``every``) meets all rows.

Defined results: rows with a NULL id, label or vector or a NULL or non-finite
component take no part, nor those whose scaled component leaves the doubles.  Vectors are compared with
those of their own length.  Rows with the anchor's id are neither its positives nor
its negatives.  Rows that repeat an id count once for each different score (and label);
an anchor id that stands for several vectors is mined for each.  A score beyond a long is ranked
exactly and shown as the nearest long.  Negative positive scores have an empty
window.  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from qualityspark.llm import common, exact

TREE = 8192
LEAF = 128
FAN = 8
BLOCK = 256
PACK = "dim int, ids binary, labels binary, mat binary"
FOUND = "aid long, slot int, positive_id long, score long, big string, vec_id long"


def prepared(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    ok = exact.usable(F.col("embedding"), scale) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return rows.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                 exact.whole(F.col("embedding"), scale).alias("v"))


def str_order(mat: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of the rows: pages of ``leaf`` consecutive rows."""
    n, dims = mat.shape
    wide = np.argsort(-(mat.max(0) - mat.min(0)), kind="stable") if n and dims else np.empty(0, int)
    order = np.arange(n)
    parts, left = [order], len(wide)
    for d in wide:
        most = max((len(p) for p in parts), default=0)
        if most <= leaf:
            break
        pages = -(-most // leaf)
        slabs = max(2, int(np.ceil(pages ** (1 / left))))
        left -= 1
        cut = []
        for p in parts:
            here = -(-len(p) // leaf)
            s = min(slabs, here)
            p = p[np.argsort(mat[p, d], kind="stable")]
            size = -(-here // s) * leaf
            cut += [p[i:i + size] for i in range(0, len(p), size)]
        parts = cut
    return np.concatenate(parts) if parts else order


class Tree:
    """Rows in STR order with the boxes of every level (level 0: leaves)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, mat: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.ids, self.labels, self.mat, self.leaf, self.fan = ids, labels, mat, leaf, fan
        at = np.arange(0, len(ids), leaf)
        self.low, self.high = [np.minimum.reduceat(mat, at)], [np.maximum.reduceat(mat, at)]
        while len(self.low[-1]) > 1:
            at = np.arange(0, len(self.low[-1]), fan)
            self.low, self.high = (self.low + [np.minimum.reduceat(self.low[-1], at)],
                                   self.high + [np.maximum.reduceat(self.high[-1], at)])

    def bounds(self, q: np.ndarray) -> list[tuple[list, list]]:
        """Per level the lower and upper bounds of each anchor's inner products: a list
        per anchor, a number per box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return [((up @ lo.T + down @ hi.T).tolist(), (up @ hi.T + down @ lo.T).tolist()) for lo, hi in zip(self.low, self.high)]

    def visit(self, bounds, anchor: int, wanted, found) -> None:
        """Best-first search of one anchor.  ``wanted(low, high)``: whether a box can matter
        now; ``found(start, end)`` takes the rows of a leaf."""
        top = len(self.low) - 1
        queue = [(-bounds[top][1][anchor][i], top, i) for i in range(len(self.low[top]))]
        heapq.heapify(queue)
        while queue:
            high, level, i = heapq.heappop(queue)
            if not wanted(bounds[level][0][anchor][i], -high):
                continue
            if level == 0:
                found(i * self.leaf, min((i + 1) * self.leaf, len(self.ids)))
                continue
            lows, highs = bounds[level - 1][0][anchor], bounds[level - 1][1][anchor]
            for c in range(i * self.fan, min((i + 1) * self.fan, len(lows))):
                if wanted(lows[c], highs[c]):
                    heapq.heappush(queue, (-highs[c], level - 1, c))


class Best:
    """The k best distinct (score, id) so far, highest score first, then smallest id."""

    def __init__(self, k: int, floor=None):
        self.k, self.floor, self.rows = k, floor, []

    def bar(self):
        """Scores strictly below cannot come in (None: all can)."""
        return self.rows[-1][0] if len(self.rows) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.bar() is not None:
            at = np.flatnonzero(scores >= self.bar())
            scores, ids = scores[at], ids[at]
        if len(scores):
            at = np.lexsort((ids, -scores)) if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
            new, last = [], None
            for i in at:
                row = (scores[i], ids[i])
                if row != last:
                    new.append(row)
                    last = row
                    if len(new) == self.k:
                        break
            self.rows = sorted(set(self.rows).union(new), key=lambda r: (-r[0], r[1]))[:self.k]


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows of packed vectors in STR order, at most ``size`` each."""
    def build(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, labels, mats = map(np.concatenate, zip(*held.pop(dim)))
            for i in range(0, len(ids), size):
                mat = mats[i:i + size]
                at = str_order(mat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), *[pa.array([x[at].tobytes()], pa.binary()) for x in (ids[i:i + size], labels[i:i + size], mat)]],
                    names=["dim", "ids", "labels", "mat"])

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            for d, at, mat in exact.matrices(batch.column(2)):
                held.setdefault(d, []).append((ids[at], labels[at], mat))
                if sum(len(x[0]) for x in held[d]) >= size:
                    yield from out(d)
        for d in sorted(held):
            yield from out(d)

    return rows.mapInArrow(build, PACK)


def _open(row: dict, prefix: str) -> tuple:
    ids, labels = (np.frombuffer(row[prefix + x], np.int64) for x in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "mat"], np.float64).reshape(len(ids), row["dim"])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [()] * 6
    shown, big = exact.shown(cols[3])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*cols[:3], shown, big, cols[5]), kinds)],
                                      names=["aid", "slot", "positive_id", "score", "big", "vec_id"])


def mine_tile(row: dict, k: int, low: int, high: int) -> list[tuple]:
    """(aid, slot, positive_id, score, vec_id-rows) of one block of anchors and one tree.  Queries are
    ``row['queries']``: per anchor (aid, vec_id, floors) in the first pass, with its positives
    (slot, id, score, floor) in the second."""
    a_ids, a_labels, q = _open(row, "a_")
    ids, labels, mat = _open(row, "")
    q, mat = exact.pair(q, mat)
    tree = Tree(ids, labels, mat)
    bounds = tree.bounds(q)
    asked: dict[int, list] = {}
    for x in row["queries"]:
        asked.setdefault(x["aid"], []).append(x)
    out = []
    for n, aid in enumerate(np.frombuffer(row["a_aids"], np.int64).tolist()):
        wins = []
        for x in asked.get(aid, []):
            floor = exact.read(x["floor"], x["floor_big"])
            if x["slot"] < 0:
                wins.append((x, None, None, Best(k, floor)))
                continue
            p = exact.read(x["score"], x["big"])
            lo, hi = -(-low * p // 100), high * p // 100
            if lo <= hi:
                wins.append((x, lo, hi, Best(k, floor)))
        if not wins:
            continue

        def wanted(b_low, b_high):
            for _, lo, hi, best in wins:
                bar = best.bar()
                if (lo is None or (b_high >= lo and b_low <= hi)) and (bar is None or b_high >= bar):
                    return True
            return False

        def found(s, e):
            score = mat[s:e] @ q[n]
            if score.dtype != object:
                score = score.astype(np.int64)
            other = ids[s:e] != a_ids[n]
            same = labels[s:e] == a_labels[n]
            for x, lo, hi, best in wins:
                ok = other & same if lo is None else other & ~same & (score >= lo).astype(bool) & (score <= hi).astype(bool)
                if ok.any():
                    best.add(score[ok], ids[s:e][ok])

        tree.visit(bounds, n, wanted, found)
        out += [(aid, x["slot"], x["positive_id"], int(s), None, int(i)) for x, _, _, best in wins for s, i in best.rows]
    return out


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    the rows whose id is divisible by ``every`` against all rows of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    common.arrow_batches(spark, 4096)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = common.materialize(prepared(rows.select("vec_id", "embedding", "label"), scale))
    slabs = vectors.repartitionByRange(F.size("v"), F.try_element_at("v", F.lit(1)), F.col("vec_id"))
    trees = common.materialize(pack(slabs.select("vec_id", "label", "v"), tree).withColumn("tree", F.monotonically_increasing_id()))
    anchors = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    anchors = common.materialize(anchors.withColumn("aid", F.monotonically_increasing_id()))
    blocks = common.materialize(_blocks(anchors, block).withColumn("block", F.monotonically_increasing_id()))
    members = common.materialize(blocks.select("block", "dim", F.explode("aid_list").alias("aid")))
    common.arrow_batches(spark, 2)  # a row is a tile from here on
    groups = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g")
    dealt = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(parts)).cast("int"))

    def scan(queries: DataFrame, k: int, sides: DataFrame) -> DataFrame:
        """Best rows of the queries, tile by tile.  ``queries``: aid, slot, positive_id, score,
        big, floor, floor_big."""
        q = (queries.join(members.select("block", "aid"), "aid").groupBy("block")
             .agg(F.collect_list(F.struct("aid", "slot", "positive_id", "score", "big", "floor", "floor_big")).alias("queries")))
        b = blocks.drop("aid_list").join(q, "block")

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    got = mine_tile(row, k, low, high)
                    if got:
                        yield _rows(got)

        return b.select("*", groups).join(sides, ["g", "dim"]).drop("g", "block", "tree").mapInArrow(run, FOUND)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("aid", "slot").orderBy(F.desc("score"), F.desc("big"), "vec_id")
        found = found.dropDuplicates(["aid", "slot", "score", "big", "vec_id"])
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    def mined(queries: DataFrame, k: int) -> DataFrame:
        """The k best of every query: a first look at one tree group for a floor, then all."""
        queries = common.materialize(queries)
        empty = (F.lit(None).cast("long").alias("floor"), F.lit(None).cast("string").alias("floor_big"))
        first = trees.groupBy("dim").agg(F.min("tree").alias("tree"))
        look = trees.join(first, ["dim", "tree"], "left_semi").withColumn("g", F.lit(0))
        look = best(scan(queries.select("*", *empty), k, look), k)
        floors = look.where(F.col("rank") == k).select("aid", "slot", F.col("score").alias("floor"), F.col("big").alias("floor_big"))
        held = common.materialize(queries.join(floors, ["aid", "slot"], "left"))
        return common.materialize(best(scan(held, k, dealt), k))

    none = [F.lit(None).cast(t).alias(c) for c, t in (("positive_id", "long"), ("score", "long"), ("big", "string"))]
    pos = mined(anchors.select("aid", F.lit(-1).alias("slot"), *none), positives)
    wins = pos.select("aid", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), "score", "big")
    neg = mined(wins, negatives)
    common.arrow_batches(spark)
    return (neg.drop("positive_id").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).drop("big")
            .join(wins.withColumnRenamed("score", "positive_score").drop("big"), ["aid", "slot"])
            .join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _blocks(anchors: DataFrame, size: int) -> DataFrame:
    """One row per block of anchors of one length."""
    def build(batches):
        for batch in batches:
            aids, ids, labels = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2))
            for d, at, mat in exact.matrices(batch.column(3)):
                for i in range(0, len(at), size):
                    s = at[i:i + size]
                    cols = [pa.array([x.tobytes()], pa.binary()) for x in (aids[s], ids[s], labels[s], mat[i:i + size])]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *cols, pa.array([aids[s].tolist()], pa.list_(pa.int64()))],
                                                     names=["dim", "a_aids", "a_ids", "a_labels", "a_mat", "aid_list"])

    few = anchors.select("aid", "vec_id", "label", "v").coalesce(max(1, int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    return few.mapInArrow(build, "dim int, a_aids binary, a_ids binary, a_labels binary, a_mat binary, aid_list array<long>")


ORACLE_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


@common.register("op13_hard_negatives", ORACLE_NEGATIVES)
def op13(spark, sf):
    rows = common.table(spark, sf, "embeddings").withColumn(
        "label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows)

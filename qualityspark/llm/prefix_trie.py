"""Prefix trie of conversations with a depth-band rollup.

A conversation is its sequence of turns; every distinct sequence of its first d turns
is a node.  A node is known by two 64-bit sums (exclusive or) over the digests of its
turns, each bound to its place, so a node's parent is found by taking the last
turn out again, and long conversations are summed bucket by bucket.

Subtree totals: depths are cut into bands of ``band``.  A node adds its weight to its ancestors
inside its band only; the top of a band, once complete, adds its total to the band above.
The band tops make a tree of their own, ``band`` times less high, which is totalled the same way: an
upward sweep (band by band, then bands of bands) and a downward one.  So a trie of height D takes about
2 log(D) / log(band) rounds, and no node is copied to more than ``band`` ancestors a round.

Scale: texts leave the scan as a digest and a word count.  Turns are placed in total order by range
partitions and cut into buckets, so one conversation with a third of all turns is many
buckets.  Counts and sums are combined before each shuffle.  Parents with very many children are spread by
a salt; they are told by a bitmap of fixed size.  The ids that end at a node are hashed in order
from joined pieces of at most ``PIECE`` ids, so a node where a third of all conversations end
is never one list.

Defined results: turns are ordered by number (NULL first), equal numbers by the digest of
(role, text); NULL roles and texts are empty; rows with a NULL conv_id take no part; repeated
rows are turns each.  A conversation without turns is a member of the root.  Extra columns
are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from qualityspark.llm import common
from qualityspark.operators.placement import place

BAND = 4
#: turns in a bucket, ids in a joined piece
BUCKET, PIECE = 1 << 16, 1 << 12
SALT = 256
KEY = ["kx", "ky"]
WORD = r"[^\\x20\\x09-\\x0D]+"


def _half(digest: Column, at: int) -> Column:
    """16 hexadecimal digits as a signed long."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, da, db, words): a turn as the digest of role and text."""
    t = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = t.withColumn("d", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return t.select("conv_id", "turn", _half(F.col("d"), 1).alias("da"), _half(F.col("d"), 17).alias("db"),
                    F.expr(f"regexp_count(text, '{WORD}')").cast("long").alias("words"))


def ordered(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(conv_id, part, pos, da, db, words): turns with their place (from 1) in the
    conversation, in parts of at most ``bucket``."""
    rows = place(turns(rows), ["conv_id", "turn", "da", "db"], bucket)
    part = rows.groupBy("conv_id", "_b0").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("_b0").rowsBetween(W.unboundedPreceding, -1))
    part = part.withColumn("before", F.coalesce(before, F.lit(0)))
    return common.materialize(rows.join(part, ["conv_id", "_b0"]).select(
        "conv_id", F.col("_b0").alias("part"), (F.col("before") + F.col("_mid") - F.col("first") + 1).alias("pos"), "da", "db", "words"))


def rebuilt(rows: DataFrame, base: Column, heads: Column, most: int, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: the first ``heads`` (an
    expression of conv_id, at most ``most``) turns of conversation ``base``, then the own
    turns after as many.  Returns (conv_id, part, pos, da, db, words) and the table of
    all conv_ids."""
    own = ordered(rows, bucket)
    size = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = common.materialize(size.select("conv_id", "n", heads.cast("long").alias("h"), base.cast("long").alias("base")))
    of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs_m = convs.join(of, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    head = own.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").drop("part")
    head = head.join(convs_m.select("base", "conv_id", "m"), "base").where(F.col("pos") <= F.col("m"))
    tail = own.join(convs_m.select("conv_id", "h", "m"), "conv_id").where(F.col("pos") > F.col("h"))
    cols = ("conv_id", "part", "pos", "da", "db", "words")
    out = (head.withColumn("part", F.lit(-1).cast("long")).select(*cols)
           .unionByName(tail.withColumn("pos", F.col("pos") - F.col("h") + F.col("m")).select(*cols)))
    return out, convs.select("conv_id")


def paths(seqs: DataFrame) -> DataFrame:
    """Every (conversation, depth) with the key of its node (kx, ky) and of the node above (px, py)."""
    rows = common.materialize(seqs.select("conv_id", "part", "pos", "words", F.xxhash64("da", "db", "pos").alias("x"),
                                          F.xxhash64("pos", "db", "da").alias("y")))
    part = rows.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    part = part.select("conv_id", "part", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("bx", "by")])
    inside = W.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(part, ["conv_id", "part"])
    rows = rows.select("conv_id", F.col("pos").alias("depth"), "words", "x", "y",
                       *[F.col(b).bitwiseXOR(F.bit_xor(c).over(inside)).alias(k) for b, c, k in (("bx", "x", "kx"), ("by", "y", "ky"))])
    return rows.select("conv_id", "depth", "words", *KEY, F.col("kx").bitwiseXOR(F.col("x")).alias("px"), F.col("ky").bitwiseXOR(F.col("y")).alias("py"))


def ends_hash(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(kx, ky, ends_sha256): SHA-256 of the comma-joined ids (ascending) of each key of (kx, ky, conv_id)."""
    placed = place(ends.select(*KEY, "conv_id"), [*KEY, "conv_id"], piece)
    joined = placed.groupBy(*KEY, "_b0").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        now, state, done = None, None, []
        for batch in batches:
            for x, y, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (x, y) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (x, y), hashlib.sha256(ids.encode())
            yield _hash_rows(done)
            done = []
        if now is not None:
            yield _hash_rows([(*now, state.hexdigest())])

    return (joined.repartition(*KEY).sortWithinPartitions(*KEY, "_b0").select(*KEY, "ids")
            .mapInArrow(run, "kx long, ky long, ends_sha256 string"))


def _hash_rows(done):
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kinds[i]) for i in range(3)], names=[*KEY, "ends_sha256"])


def band_levels(rows: DataFrame, height: int, band: int = BAND) -> list[DataFrame]:
    """Level by level (nodes at every ``band ** level``-th depth): (kx, ky, top, path), path being
    the keys of the ancestors of the same level from the last band top before the node on, and
    top whether the node is a band top itself."""
    out, at = [], rows.select("conv_id", F.col("depth").alias("e"), *KEY, F.struct(F.col("px").alias("kx"), F.col("py").alias("ky")).alias("p"))
    while height > 0:
        group = W.partitionBy("conv_id", F.expr(f"(e - 1) div {band}")).orderBy("e").rowsBetween(W.unboundedPreceding, 0)
        at = common.materialize(at.withColumn("path", F.collect_list("p").over(group)))  # at most ``band`` keys
        out.append(common.materialize(at.groupBy(*KEY).agg((F.first("e") % band == 0).alias("top"), F.first("path").alias("path"))))
        at = at.where(F.col("e") % band == 0).select("conv_id", F.expr(f"e div {band}").alias("e"), *KEY, F.element_at("path", 1).alias("p"))
        height //= band
    return out


def subtree_totals(weights: DataFrame, levels: list[DataFrame], what: list[str]) -> DataFrame:
    """Sums of the columns ``what`` over the subtree of every node.  ``weights``: a row per
    node (kx, ky, *what), the root's key being (0, 0)."""
    sums = [F.sum(c).alias(c) for c in what]
    held = [weights]
    for level in levels:  # up: a band's weights go to its top
        top = F.when(F.coalesce("top", F.lit(True)), F.struct(*KEY)).otherwise(F.element_at("path", 1))
        up = held[-1].join(level, KEY, "left").withColumn("t", top)
        held.append(common.materialize(up.groupBy("t.kx", "t.ky").agg(*sums)))
    total = held[-1]  # the root alone
    for level, weight in zip(reversed(levels), reversed(held[:-1])):  # down: tops are complete
        at = weight.join(level, KEY, "left").withColumn("top", F.coalesce("top", F.lit(True)))
        rest = at.where(~F.col("top"))
        to = F.explode(F.concat(F.array(F.struct(*KEY)), "path")).alias("t")
        inner = rest.select(to, *what)
        tops = total.join(level, KEY).select(F.explode("path").alias("t"), *what)
        known = total.select(F.struct(*KEY).alias("t"), *what, F.lit(True).alias("known"))
        both = inner.unionByName(tops).withColumn("known", F.lit(False)).unionByName(known)
        # a top has its total already; what its band adds to it again is left out
        part = both.groupBy("t").agg(*[F.sum(F.when(~F.col("known"), F.col(c))).alias(f"a_{c}") for c in what],
                                     *[F.sum(F.when(F.col("known"), F.col(c))).alias(c) for c in what])
        total = common.materialize(part.select("t.kx", "t.ky", *[F.coalesce(c, f"a_{c}").alias(c) for c in what]))
    return total


def with_parents(nodes: DataFrame, salt: int = SALT) -> DataFrame:
    """``nodes`` plus parent_conv_id; parents of at least ``salt`` children are copied ``salt`` times."""
    heavy = nodes.where(F.col("n_children") >= salt).select(F.xxhash64(*KEY).alias("k"))
    spread = F.sequence(F.lit(0), F.lit(salt - 1))
    flagged = common.materialize(nodes.withColumn("hot", common.bit_column(heavy, F.xxhash64(*KEY)))
                                 .withColumn("p_hot", common.bit_column(heavy, F.xxhash64("px", "py"))))
    above = flagged.select(F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv_id").alias("parent_conv_id"),
                           F.explode(F.when(F.col("hot"), spread).otherwise(F.array(F.lit(0)))).alias("s"))
    below = flagged.withColumn("s", F.when(F.col("p_hot"), F.pmod(F.xxhash64(*KEY), F.lit(salt)).cast("int")).otherwise(0))
    return below.join(above, ["px", "py", "s"], "left").drop("s", "hot", "p_hot")


def trie(seqs: DataFrame, convs: DataFrame, band: int = BAND, piece: int = PIECE, salt: int = SALT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  ``seqs``: (conv_id, part, pos, da, db, words), places from 1 without
    gaps, parts ascending with the places; ``convs``: all conv_ids, those without turns included."""
    rows = common.materialize(paths(seqs))
    height = rows.agg(F.max("depth")).first()[0] or 0
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    none = [F.lit(None).cast("long").alias(c) for c in ("px", "py")]
    found = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
                                   F.min("words").alias("words"), F.min("px").alias("px"), F.min("py").alias("py"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *none)
    found = common.materialize(found.unionByName(root))
    children = found.where(F.col("px").isNotNull()).groupBy(F.col("px").alias("kx"), F.col("py").alias("ky")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = common.materialize(found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    weights = nodes.select(*KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    total = subtree_totals(weights, band_levels(rows, height, band), ["n_leaves", "saved_tokens"])
    last = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = (rows.select("conv_id", "depth", *KEY).join(last, ["conv_id", "depth"]).select("conv_id", *KEY)
            .unionByName(convs.join(last, "conv_id", "left_anti").select("conv_id", *zero)))
    hashed = ends_hash(ends, piece)
    out = with_parents(nodes, salt).join(total, KEY).join(hashed, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE_TRIE = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, words FROM (
    SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
), n AS (
  SELECT c, max(pos) AS n, list_reduce(list_concat([4294967295::BIGINT], list_transform(generate_series(1, len(CAST(c AS VARCHAR))),
      lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM t GROUP BY c
), h AS MATERIALIZED (
  SELECT n.c, n.c - n.c % 20 AS base, xor(n.crc, 4294967295::BIGINT) % 4 AS h,
         least(xor(n.crc, 4294967295::BIGINT) % 4, coalesce(b.n, 0)) AS m
  FROM n LEFT JOIN n b ON b.c = n.c - n.c % 20
), r AS MATERIALIZED (
  SELECT h.c, t.pos AS d, t.d AS digest, words FROM h JOIN t ON t.c = h.base AND t.pos <= h.m
  UNION ALL SELECT h.c, t.pos - h.h + h.m, t.d, words FROM h JOIN t ON t.c = h.c AND t.pos > h.h
), s AS MATERIALIZED (
  SELECT c, d, words, sha256(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY d)) AS k,
         CASE WHEN d = 1 THEN '' ELSE sha256(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS up,
         d = max(d) OVER (PARTITION BY c) AS ends FROM r
  UNION ALL SELECT h.c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.c = h.c) FROM h
), node AS MATERIALIZED (
  SELECT k, min(c) AS c, min(d) AS d, count(*) AS n, min(words) AS words, min(up) AS up,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM s GROUP BY k
), kids AS (
  SELECT up AS k, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up
), w AS (
  SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)
), total AS (
  SELECT a.k, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * w.words) AS saved
  FROM w JOIN s a ON a.c = w.c AND a.d <= w.d GROUP BY a.k
)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, p.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN total USING (k) LEFT JOIN node p ON p.k = w.up
"""


@common.register("op11_prefix_trie", ORACLE_TRIE)
def op11(spark, sf):
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    seqs, convs = rebuilt(common.table(spark, sf, "conversations"), base, head, most=3)
    return trie(seqs, convs)

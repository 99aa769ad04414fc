"""N-gram Jaccard join by filtering under several global token orders.

Documents are sets of distinct word shingles.  Two sets link when
``100 * |A n B| >= percent * |A u B|``.

Under *any* total order of the shingles, linked sets share a shingle within
their prefixes of ``|S| - ceil(t |S|) + 1`` first shingles.  Candidates come
from the prefixes of the first order (hash order, with shingles that a sample
of documents shows to be frequent moved to the end); a candidate pair must
then also share prefix shingles under the other orders, and only then the
exact overlap is taken.

Scale:

* Equal sets (128-bit fingerprints) are one class from the first step on.
* Prefix entries are dealt by shingle; a shingle holds at most one entry per
  class, and long lists are cut into chunk pairs, so no list meets in a task.
* Near-copy families would make all-pairs output.  They are joined first: the
  leading shingle of each order deals classes into small groups, where only a
  spanning forest of verified links is kept.  Afterwards a prefix list matters
  only if it holds classes of different components, and only pairs across
  components that pass length and parity-bitmap bounds are verified.  The
  component result equals that of verifying every candidate pair.
* The parity bitmap (each bit the parity of the number of shingles hashed to
  it, about one bit per two shingles) gives a safe bound: differing bits never
  exceed the symmetric difference.  Only classes with a partner inside the bounds
  have their sets read again.

Defined results: NULL or word-free texts have no shingles, link with nothing
and are their own component; fewer than ``n`` words make one shingle of the
whole sequence; repeated rows are equal sets and link; a NULL id never names a
component (a component of NULL ids only has a NULL id).  Only the id and text
columns are read, so extra columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

U = np.uint64
ORDERS = 3          # global token orders
BITS = 512          # parity bitmap of up to 1024 shingles; four times as many for each four times more
CHUNK = 2048        # classes of one list or group held together
SAMPLE = 8          # one document in so many steers the first order
HOT_MOST = 1 << 16  # shingles moved to the end of the first order, at most
SALT = 16
SET_MARK = 101
BITMAP_MARK = 77


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(texts, n: int, words: np.ndarray = tb.SPACE_WORDS, hasher: list | None = None) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text of an Arrow string array."""
    h = hasher or [tb.WordHash(0)]
    data, off = tb.string_buffers(texts)
    data = tb.LOWER[data]
    doc, s, e = tb.word_spans(data, off, words)
    w = h[0](data, s, e)
    count = np.bincount(doc, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    grams = tb.rolling(w, n)
    out = []
    for i, c in enumerate(count):
        if c >= n:
            out.append(np.unique(grams[at[i]:at[i + 1] - n + 1]))
        elif c:
            out.append(tb.rolling(w[at[i]:at[i + 1]], int(c)))
        else:
            out.append(np.empty(0, U))
    return out


def order_key(tokens: np.ndarray, order: int) -> np.ndarray:
    return tb.salted(tokens, order)


def prefix(tokens: np.ndarray, order: int, percent: int, hot: np.ndarray | None = None) -> np.ndarray:
    """First tokens under a global order; ``hot`` (sorted) tokens come last."""
    if not len(tokens):
        return tokens
    key = order_key(tokens, order) >> U(1)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        key = key | ((hot[at] == tokens).astype(U) << U(63))
    p = prefix_length(len(tokens), percent)
    return tokens[np.argpartition(key, p - 1)[:p]] if p < len(tokens) else tokens


def bitmap_bits(n: int) -> int:
    bits = BITS
    while n > 2 * bits:
        bits *= 4
    return bits


def parity(tokens: np.ndarray) -> np.ndarray:
    bits = bitmap_bits(len(tokens))
    at = (tb.salted(tokens, BITMAP_MARK) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test, after the prefix filters of the other orders."""
    n, m = len(a), len(b)
    if percent * max(n, m) > 100 * min(n, m):
        return False
    for k in range(1, ORDERS):
        if not len(np.intersect1d(prefix(a, k, percent), prefix(b, k, percent), assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (n + m - both)


class Bounds:
    """Length and bitmap bounds over a group sorted by set size; never false
    for a linked pair.  With overlap o >= t (n1 + n2) / (1 + t), the symmetric
    difference n1 + n2 - 2 o is at most (1 - t) (n1 + n2) / (1 + t).  Larger sets'
    bitmaps are folded to the size of the smaller set's."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int):
        self.n, self.percent, self.levels = sizes, percent, {}
        words = np.array([len(b) for b in bitmaps])
        for w in np.unique(words):
            first = int(np.searchsorted(words, w))
            self.levels[int(w)] = (first, np.stack([b.reshape(-1, w) if len(b) == w else
                                                    np.bitwise_xor.reduce(b.reshape(-1, w))[None] for b in bitmaps[first:]])[:, 0])
        self.words = words

    def partners(self, i: int) -> np.ndarray:
        """Positions after ``i`` that may link with it."""
        stop = int(np.searchsorted(self.n, 100 * self.n[i] // self.percent, "right"))
        if stop <= i + 1:
            return np.empty(0, np.int64)
        first, bits = self.levels[int(self.words[i])]
        differ = np.bitwise_count(bits[i + 1 - first:stop - first] ^ bits[i - first]).sum(axis=1, dtype=np.int64)
        fits = (100 + self.percent) * differ <= (100 - self.percent) * (self.n[i + 1:stop] + self.n[i])
        return i + 1 + np.flatnonzero(fits)


# ---------------------------------------------------------------- scans

def _signatures(docs: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    schema = ("doc_id long, text_hash long, n long, s1 long, s2 long, prefix array<long>, bitmap binary, lead array<long>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = [tb.WordHash(0)]
        for batch in batches:
            for part in tb.slices(batch, "text"):
                sets = shingle_sets(part.column(1), n, hasher=h)
                size = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.empty(0, U)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(tb.salted(flat, SET_MARK + k))]) for k in (0, 1)]
                s1, s2 = (x[at[1:]] - x[at[:-1]] for x in sums)
                some = [x if len(x) else None for x in sets]
                lead = [np.array([x[np.argmin(order_key(x, k))] for k in range(ORDERS)]) if x is not None
                        else np.empty(0, U) for x in some]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(size), pa.array(tb.signed(s1)), pa.array(tb.signed(s2)),
                    tb.ragged([tb.signed(prefix(x, 0, percent, hot)) for x in sets]),
                    pa.array([parity(x).tobytes() for x in sets], pa.binary()),
                    tb.ragged([tb.signed(x) for x in lead])],
                    names=["doc_id", "text_hash", "n", "s1", "s2", "prefix", "bitmap", "lead"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(scan, schema)


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles seen in several documents of a sample, most frequent first, at
    most ``HOT_MOST``.  They only shape the first order: any order is right."""
    def scan(batches):
        h = [tb.WordHash(0)]
        for batch in batches:
            for part in tb.slices(batch, "text"):
                sets = [x for x in shingle_sets(part.column(1), n, hasher=h) if len(x)]
                t, c = np.unique(np.concatenate(sets) if sets else np.empty(0, U), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(t)), pa.array(c.astype(np.int64))], names=["t", "c"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SAMPLE)) == 0)
    counts = common.materialize(some.mapInArrow(scan, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).where("c >= 2"))
    # the lowest count at which the list still fits; one small row per count
    sizes = counts.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    held, least = 0, 10_001
    for r in sizes:
        held += r["n"]
        if held > HOT_MOST:
            break
        least = r["c"]
    return np.sort(counts.where(F.col("c") >= least).select("t").toPandas()["t"].to_numpy(np.int64).view(U))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, n, bitmap, tokens) of the wanted classes: their representatives'
    texts are read again, found through a bitmap of bounded size."""
    bits = common.collect_bits(wanted.select(F.xxhash64("min_doc").alias("k")), "k", 22)

    def scan(batches):
        h = [tb.WordHash(0)]
        for batch in batches:
            keep = tb_keep(batch.column(2).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for part in tb.slices(batch, "text") if batch.num_rows else ():
                sets = shingle_sets(part.column(1), n, hasher=h)
                s1 = np.array([tb.salted(x, SET_MARK).sum(dtype=U) for x in sets], U)
                s2 = np.array([tb.salted(x, SET_MARK + 1).sum(dtype=U) for x in sets], U)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tb.signed(s1)), pa.array(tb.signed(s2)), tb.ragged([tb.signed(x) for x in sets])],
                    names=["s1", "s2", "tokens"])

    def tb_keep(keys):
        return common.bit_test(bits, keys.astype(np.int64).view(U))

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k")).mapInArrow(
        scan, "s1 long, s2 long, tokens array<long>")
    # equal ids and sets may be in several rows
    one = found.groupBy("s1", "s2").agg(F.first("tokens").alias("tokens"))
    return one.join(wanted.select("cid", "s1", "s2", "n", "bitmap"), ["s1", "s2"]).select("cid", "n", "bitmap", "tokens")


# ---------------------------------------------------------------- families

class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[p]
            x = self.up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest_of(ids, sizes, bitmaps, sets, percent: int, forest: _Forest) -> list[tuple[int, int]]:
    """Verified links that connect the linked members of one small group."""
    order = np.argsort(sizes, kind="stable")
    near = Bounds(np.asarray(sizes)[order], [bitmaps[i] for i in order], percent)
    edges = []
    for i, a in enumerate(order):
        for j in near.partners(i):
            b = order[j]
            if forest.root(ids[a]) != forest.root(ids[b]) and linked(sets[a], sets[b], percent):
                forest.union(ids[a], ids[b])
                edges.append((ids[a], ids[b]))
    return edges


def _family_links(groups: DataFrame, percent: int) -> DataFrame:
    """``groups``: (k, cid, n, bitmap, tokens), rows of a key together.  A group
    is worked off in chunks; one member per component found so far is carried
    along (the ``CHUNK / 4`` latest), so chunks of a family meet."""
    def scan(batches):
        key, rows, forest = None, [], _Forest()

        def flush(last: bool):
            nonlocal rows, forest
            edges = []
            if len(rows) > 1:
                ids, sizes, bits, sets = map(list, zip(*rows))
                edges = _forest_of(ids, sizes, bits, sets, percent, forest)
                keep = {forest.root(i): r for i, r in zip(ids, rows)}
                rows = list(keep.values())[-CHUNK // 4:]
            if last:
                rows, forest = [], _Forest()
            return edges

        def out(edges):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

        weight = 0
        for batch in batches:
            ks, cids, ns = (batch.column(i).to_numpy() for i in range(3))
            bm, tok = batch.column(3), batch.column(4)
            off = tok.offsets.to_numpy()
            flat = tok.values.to_numpy().view(U)
            edges = []
            for i in range(batch.num_rows):
                if ks[i] != key or len(rows) >= CHUNK or weight > 4_000_000:
                    edges += flush(ks[i] != key)
                    key, weight = ks[i], sum(len(r[3]) for r in rows)
                rows.append((int(cids[i]), int(ns[i]), np.frombuffer(bm[i].as_py(), U), flat[off[i]:off[i + 1]].copy()))
                weight += int(ns[i])
            if edges:
                yield out(edges)
        yield out(flush(True))

    return groups.mapInArrow(scan, "a long, b long")


# ---------------------------------------------------------------- prefix lists

def _tiles(lists: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """Prefix lists with sizes and bitmaps; a list of c classes is cut into
    ceil(c / CHUNK) chunks, and every pair of chunks is a tile."""
    chunks = F.ceil(F.col("c") / CHUNK).cast("int")
    return (lists.join(classes.select("cid", "n", "bitmap"), "cid")
            .withColumn("m", F.pmod(F.xxhash64("cid"), chunks).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
            .select("token", F.least("m", "o").alias("tile_i"), F.greatest("m", "o").alias("tile_j"),
                    F.col("m").alias("side"), "cid", "n", "comp", "bitmap")
            .repartition(parts, "token", "tile_i", "tile_j")
            .sortWithinPartitions("token", "tile_i", "tile_j"))


def _scan_tiles(tiles: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Members of different components that pass the bounds: as pairs, or only
    the classes that have any such partner."""
    def inside(rows):
        rows.sort(key=lambda r: r[1])
        cid, n, comp, side = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        near = Bounds(n, [r[4] for r in rows], percent)
        any_partner = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            j = near.partners(i)
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] < 0))]
            if pairs:
                for x in j:
                    yield min(cid[i], cid[x]), max(cid[i], cid[x])
            elif len(j):
                any_partner[j] = any_partner[i] = True
        for x in cid[any_partner]:
            yield x, x

    def scan(batches):
        key, rows, found = None, [], set()

        def out():
            got = list(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            t, ti, tj, sd, cid, n, comp = (batch.column(i).to_numpy() for i in range(7))
            bm = batch.column(7)
            for i in range(batch.num_rows):
                k = (t[i], ti[i], tj[i])
                if k != key:
                    if len(rows) > 1:
                        found.update(inside(rows))
                    key, rows = k, []
                rows.append((cid[i], n[i], comp[i], sd[i] if ti[i] != tj[i] else -1, np.frombuffer(bm[i].as_py(), U)))
            if len(found) > 50_000:
                yield out()
        if len(rows) > 1:
            found.update(inside(rows))
        yield out()

    return tiles.mapInArrow(scan, "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"))

    def scan(batches):
        for batch in batches:
            cols = []
            for i in (2, 3):
                c = batch.column(i)
                cols.append((c.offsets.to_numpy(), c.values.to_numpy().view(U)))
            (oa, fa), (ob, fb) = cols
            ok = [linked(fa[oa[i]:oa[i + 1]], fb[ob[i]:ob[i + 1]], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(scan, "a long, b long"))


# ---------------------------------------------------------------- operator

def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, text_hash (xxhash64), n_shingles, component_id
    (smallest linked id) and component (its key, also where ids are NULL; NULL
    for a document without shingles)."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = frequent_tokens(docs, n)
    sig = common.materialize(_signatures(docs, n, percent, hot).withColumn("uid", F.monotonically_increasing_id()))
    # a class is named by the row of its smallest document
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    classes = common.materialize(
        sig.where("n > 0").groupBy("s1", "s2", "n")
        .agg(F.min_by("uid", first).alias("cid"), F.min("doc_id").alias("min_doc"), F.first("bitmap").alias("bitmap"),
             F.first("lead").alias("lead"), F.count(F.lit(1)).alias("copies")))

    # prefix lists of at least two classes; of equal sets only the naming row enters,
    # which takes a join only where there may be copies
    named_by = classes.where("copies > 1").select("s1", "s2", "cid")
    copied = common.bit_column(named_by.select(F.xxhash64("s1", "s2").alias("k")), F.xxhash64("s1", "s2"))
    rows = sig.where("n > 0").select("uid", "s1", "s2", "prefix")
    held = (rows.where(copied).join(named_by, ["s1", "s2"], "left")
            .where("cid IS NULL OR cid = uid"))
    entries = (rows.where(~copied).select("uid", "prefix").unionByName(held.select("uid", "prefix"))
               .select(F.col("uid").alias("cid"), F.explode("prefix").alias("token")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "token")
    shared = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = common.materialize(dealt.join(shared, "token").select("token", "cid", F.col("c").cast("int").alias("c")))

    # classes with a partner inside the bounds; their sets are read again
    partner = _scan_tiles(_tiles(lists.withColumn("comp", F.col("cid")), classes, parts), percent, pairs=False)
    involved = common.materialize(classes.join(partner.select(F.col("a").alias("cid")), "cid", "left_semi"))
    lists = lists.join(involved.select("cid"), "cid", "left_semi")
    sets = common.materialize(_sets_of(docs, involved, n))

    # family links: groups by the leading shingle under each order
    lead = involved.select("cid", F.explode("lead").alias("t"))
    many = lead.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    seeds = (lead.join(many, "t")
             .select("cid", F.xxhash64("t", F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / CHUNK))).alias("k")).distinct())
    groups = (seeds.join(sets, "cid").select("k", "cid", "n", "bitmap", "tokens")
              .repartition(parts, "k").sortWithinPartitions("k", "cid"))
    near = common.materialize(_family_links(groups, percent))
    comp = common.materialize(common.components(near))

    # pairs across components, from every prefix list that still holds several
    who = (lists.join(comp, lists.cid == comp.node, "left")
           .select("token", "cid", "c", F.coalesce("comp", "cid").alias("comp")))
    mixed = (who.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"))
             .where("lo <> hi").select("token", "c"))
    pairs = common.materialize(_scan_tiles(_tiles(who.drop("c").join(mixed, "token"), classes, parts), percent, pairs=True))
    links = near.unionByName(_verify(pairs, sets, percent))
    comp = common.components(links)

    ids = (classes.join(comp, classes.cid == comp.node, "left")
           .select("s1", "s2", "min_doc", F.coalesce("comp", "cid").alias("comp")))
    named = ids.groupBy("comp").agg(F.min("min_doc").alias("component_id"))
    final = ids.join(named, "comp").select("s1", "s2", "comp", "component_id")
    out = sig.select("doc_id", "text_hash", "n", "s1", "s2").join(final, ["s1", "s2"], "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.when(F.col("n") > 0, F.col("comp")).alias("component"))


def one_per_component(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one row of every component: the smallest id, then text
    hash, then the other columns as text.  Documents without shingles stay."""
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    got = common.materialize(jaccard_components(docs, **kw).where("n_shingles > 0"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = got.groupBy("component").agg(F.min(key).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # a component may be huge
    rows = (got.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("same"))
            .withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALT)).cast("int"))
            .join(first, ["component", "salt"]))
    kept = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash"))
    keys = common.materialize(rows.where(~kept | (F.col("same") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), kept.alias("__kept")))
    rest, found = common.split_rows(docs, keys, id_col, text_col)
    w = W.partitionBy("__id", "__hash").orderBy(*[F.col(c).cast("string") for c in docs.columns if c != text_col])
    alone = found.where("__kept IS NULL")
    twin = found.where("__kept").withColumn("__rank", F.row_number().over(w)).where("__rank = 1")
    return (rest.unionByName(alone.select(*docs.columns)).unionByName(twin.select(*docs.columns)))


ORACLE_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sized AS (
  SELECT doc_id, len(g) AS n, g FROM grams
), tokens AS (
  SELECT doc_id, n, unnest(g) AS t FROM sized
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(src, dst) AS (
  SELECT doc_id, doc_id FROM sized
  UNION SELECT reach.src, links.b FROM reach JOIN links ON reach.dst = links.a
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, c.component_id
FROM sized s JOIN (SELECT src, min(dst) AS component_id FROM reach GROUP BY src) c ON s.doc_id = c.src
"""


@common.register("op10_ngram_jaccard_join", ORACLE_JACCARD)
def op10(spark, sf):
    got = jaccard_components(common.table(spark, sf, "documents"))
    return got.select("doc_id", "n_shingles", "component_id")

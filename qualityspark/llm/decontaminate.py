"""Benchmark decontamination by winnowed fingerprints.

A window is ``span`` consecutive words of a benchmark item (the whole item if
it is shorter).  Winnowing keeps, of the ``span - k + 1`` k-gram hashes of a
window, the smallest; equal windows therefore keep the same fingerprint, so
every shared run of at least ``span`` words is found.  Document fingerprints
are first tested against a bitmap of the benchmark's (16 bits for each, 16 MB at
most; a fuller bitmap lets more through, never less), then each kept hit is
extended to its whole window and joined with the benchmark windows on a 128-bit
window hash.

Scale: documents are read once; what is shuffled are the few windows whose
fingerprint is in the benchmark.  A passage that a third of all documents
share is one hot window, so the join is salted by document.  No list of items
or documents is collected.

Defined results: NULL or word-free texts have no words and are clean; items
without words give no window; items of equal id count once; a NULL item id
marks words but is not counted or listed; repeated document rows are judged one
by one.  Extra columns are ignored; an empty benchmark leaves all documents
clean.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

U = np.uint64
SALT = 16


def _words(column, hasher) -> tuple[np.ndarray, np.ndarray]:
    data, off = tb.string_buffers(column)
    data = tb.LOWER[data]
    doc, s, e = tb.word_spans(data, off, tb.ALNUM_WORDS)
    return doc, hasher(data, s, e)


def _second(words: np.ndarray, k: int) -> np.ndarray:
    return tb.rolling(tb.salted(words, 5), k)


def _windows(doc: np.ndarray, length: int) -> np.ndarray:
    """Start positions of the windows of ``length`` words inside one text."""
    n = len(doc) - length + 1
    return np.flatnonzero(doc[:n] == doc[length - 1:]) if n > 0 else np.empty(0, np.int64)


def _fingerprints(words: np.ndarray, at: np.ndarray, length: int, span: int, k: int) -> np.ndarray:
    """Winnowed fingerprint of the windows at ``at``; windows shorter than
    ``span`` are their own fingerprint."""
    if length < span:
        return tb.salted(tb.rolling(words, length), length)[at]
    grams = tb.salted(tb.rolling(words, k), 99)
    n = len(words) - span + 1
    low = grams[:n].copy()
    for j in range(1, span - k + 1):
        np.minimum(low, grams[j:j + n], out=low)
    return low[at]


def benchmark_windows(bench: DataFrame, span: int, k: int) -> DataFrame:
    """Distinct (len, h1, h2, fp, item_id) of all item windows."""
    def scan(batches):
        h = tb.WordHash(0)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                doc, w = _words(part.column(1), h)
                count = np.bincount(doc, minlength=part.num_rows)
                cols = [[], [], [], [], []]
                for length in np.unique(np.minimum(count[count > 0], span)):
                    at = _windows(doc, int(length))
                    at = at[np.minimum(count[doc[at]], span) == length]
                    cols[0].append(np.full(len(at), length, np.int64))
                    cols[1].append(tb.signed(tb.rolling(w, int(length))[at]))
                    cols[2].append(tb.signed(_second(w, int(length))[at]))
                    cols[3].append(tb.signed(_fingerprints(w, at, int(length), span, k)))
                    cols[4].append(doc[at])
                arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols]
                arrays[4] = part.column(0).take(arrays[4])
                yield pa.RecordBatch.from_arrays(arrays, names=["len", "h1", "h2", "fp", "item_id"])

    return (bench.select(F.col("item_id").cast("string"), "text")
            .mapInArrow(scan, "len long, h1 long, h2 long, fp long, item_id string").distinct())


def _candidates(docs: DataFrame, bitmap: np.ndarray, lengths: list[int], span: int, k: int) -> DataFrame:
    """Per document row: number of words and the windows whose fingerprint the
    benchmark has."""
    def scan(batches):
        h = tb.WordHash(0)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                doc, w = _words(part.column(2), h)
                rows = [[], [], [], [], []]
                for length in lengths:
                    at = _windows(doc, length)
                    if len(at):
                        at = at[common.bit_test(bitmap, _fingerprints(w, at, length, span, k))]
                    if len(at):
                        for c, x in zip(rows, (doc[at], at, np.full(len(at), length),
                                               tb.signed(tb.rolling(w, length)[at]), tb.signed(_second(w, length)[at]))):
                            c.append(x)
                of, at, ln, h1, h2 = (np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in rows)
                o = np.argsort(of, kind="stable")
                count = np.bincount(doc, minlength=part.num_rows)
                first = np.concatenate([[0], np.cumsum(count)])
                cut = pa.array(np.searchsorted(of[o], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x[o])) for x in (at - first[of], ln, h1, h2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3),
                                                  pa.array(count.astype(np.int64)), *lists],
                                                 names=["uid", "doc_id", "text_hash", "n_words", "at", "len", "h1", "h2"])

    return docs.mapInArrow(scan, "uid long, doc_id long, text_hash long, n_words long, at array<long>, len array<long>, "
                                 "h1 array<long>, h2 array<long>")


def decontaminate(docs: DataFrame, bench: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted as
    strings), windows (start and length in words of each occurring window)."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    wins = common.materialize(benchmark_windows(bench, span, k))
    size = wins.agg(F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    bits = min(27, max(16, math.ceil(math.log2(16 * max(1, size["n"])))))
    bitmap = common.collect_bits(wins, "fp", bits)
    cand = common.materialize(_candidates(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), bitmap, sorted(size["lens"]), span, k))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    one = (cand.where(F.size("at") > 0)
           .select("uid", F.explode(F.arrays_zip("at", "len", "h1", "h2")).alias("w")).select("uid", "w.*"))
    known = wins.select("len", "h1", "h2").distinct().withColumn("salt", salt)
    hits = common.materialize(one.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALT)).cast("int"))
                              .join(known, ["len", "h1", "h2", "salt"]))
    cover = (hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "len"))).alias("windows"))
             .withColumn("n_hit", F.expr(
                 "aggregate(windows, named_struct('n', 0L, 'e', 0L), (s, x) -> named_struct("
                 "'n', s.n + greatest(0L, x.at + x.len - greatest(s.e, x.at)), 'e', greatest(s.e, x.at + x.len)), s -> s.n)")))
    items = (hits.select("uid", "len", "h1", "h2", "salt").distinct()
             .join(wins.where("item_id IS NOT NULL").select("len", "h1", "h2", "item_id").withColumn("salt", salt),
                   ["len", "h1", "h2", "salt"])
             .select("uid", "item_id").distinct()
             .groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    none = F.array().cast("array<string>")
    return (cand.select("uid", "doc_id", "text_hash", "n_words").join(cover, "uid", "left").join(items, "uid", "left")
            .select("uid", "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"), "windows"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs."""
    got = decontaminate(docs, bench, **kw)
    keys = common.materialize(got.where("n_hit > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.lit(True).alias("__bad")).distinct())
    rest, found = common.split_rows(docs, keys, kw.get("id_col", "doc_id"), kw.get("text_col", "text"))
    return rest.unionByName(found.where("__bad IS NULL").select(*docs.columns))


ORACLE_DECONTAMINATE = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bl AS (
  SELECT item_id, w, least(len(w), 10) AS l FROM bw WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2),
         lambda i: array_to_string(w[i:i + l - 1], ' '))) AS win FROM bl
), lens AS (
  SELECT DISTINCT l FROM wins
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), pos AS (
  SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l
), hits AS (
  SELECT p.doc_id, p.i, p.l, s.item_id
  FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM pos) p JOIN wins s ON p.win = s.win AND p.l = s.l
), cover AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS j FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""


@common.register("op4_decontaminate", ORACLE_DECONTAMINATE)
def op4(spark, sf):
    got = decontaminate(common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))

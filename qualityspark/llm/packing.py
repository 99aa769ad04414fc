"""Best-fit packing under conflicts.

Documents are packed into bins of ``capacity`` tokens.  Two pieces may not
share a bin if they have the same source or belong to the same duplicate
cluster.  Open bins are kept in order of their residual space, each with a
bitmap of its sources and one of its duplicate clusters.  A piece (largest
first) looks for the tightest bin that holds it, and goes on to the successors
until a compatible one is found; only then a bin is opened.

Longer documents are cut into pieces; full pieces fill a bin alone, the rest is
packed like a short document.  Every document takes one token more than it has
words (its end mark), so documents without words are packed too.

The duplicate cluster is the value of ``cluster_col`` if one is named (for example the components
of a near-duplicate join), else equality of the word sequence.

Scale: one scan measures all documents (words and a 128-bit hash of the
normalised text).  Best-fit is then run on shards of about
``SHARD`` documents, dealt by a hash of the measured values and a copy number, so a hot source or cluster is
spread evenly and the bins do not depend on how the rows lie in files; a shard holds sizes and ids
only, never texts.

Defined results: NULL text has no words; a NULL source conflicts with nothing;
rows without words are in no duplicate cluster; repeated rows are packed each, in
different bins if they share a source or have words.  An empty table gives no
bins.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

SHARD = 4096
OUT = "bin_id long, slot int, doc_id long, source string, piece int, start_token long, n_tokens int"


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, cluster, given) per row of (doc_id, source, text, given); cluster is NULL without words."""
    def scan(batches):
        h = tb.WordHash(0)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                data, off = tb.string_buffers(part.column(2))
                data = tb.LOWER[data]
                n = part.num_rows
                tokens = np.bincount(tb.word_spans(data, off, tb.SPACE_WORDS)[0], minlength=n) + 1
                doc, s, e = tb.word_spans(data, off, tb.ALNUM_WORDS)
                count = np.bincount(doc, minlength=n)
                first = np.concatenate([[0], np.cumsum(count)])
                place = (np.arange(len(doc)) - first[doc]).astype(np.uint64)
                w = h(data, s, e) + tb.mix(place)
                both = []
                for k in (11, 12):
                    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.salted(w, k))])
                    both.append(c[first[1:]] - c[first[:-1]])
                cluster = [f"{a:016x}{b:016x}" if m else None for a, b, m in zip(*both, count)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens.astype(np.int64)),
                                                  pa.array(cluster, pa.string()), part.column(3)],
                                                 names=["doc_id", "source", "n_tokens", "cluster", "given"])

    return docs.mapInArrow(scan, "doc_id long, source string, n_tokens long, cluster string, given string")


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of every item (size, source bitmap, cluster bitmap), in the given
    order."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources, clusters, out = [], [], []
    for size, src, dup in items:
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & src or clusters[b] & dup):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= src
        clusters[b] |= dup
        if left > size:
            insort(order, (left - size, b))
        out.append(b)
    return out


def _bits(values: pd.Series, shared_only: bool) -> list[int]:
    """One bit for each value; none for missing or (``shared_only``) single ones."""
    count = values.value_counts()
    if shared_only:
        count = count[count > 1]
    place = {v: i for i, v in enumerate(sorted(count.index))}
    return [1 << place[v] if v in place else 0 for v in values]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one shard; bins are numbered from 0."""
    rows = rows.sort_values(["n_tokens", "doc_id", "source", "cluster", "copy"], ascending=[False, True, True, True, True], ignore_index=True)
    n = rows["n_tokens"].to_numpy(np.int64)
    full, rest = n // capacity, n % capacity
    of = np.repeat(np.arange(len(rows)), full)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
    whole = pd.DataFrame({"row": of, "piece": piece, "n": capacity, "bin": np.arange(len(of))})
    small = np.flatnonzero(rest)
    small = small[np.argsort(-rest[small], kind="stable")]
    src, dup = _bits(rows["source"], False), _bits(rows["cluster"], True)
    bins = best_fit([(int(rest[i]), src[i], dup[i]) for i in small], capacity)
    part = pd.DataFrame({"row": small, "piece": full[small], "n": rest[small],
                         "bin": np.asarray(bins, np.int64) + len(of)})
    got = pd.concat([whole, part], ignore_index=True)
    got["slot"] = got.groupby("bin").cumcount()
    at = got["row"].to_numpy(np.int64)
    return pd.DataFrame({"bin_id": got["bin"], "slot": got["slot"], "doc_id": rows["doc_id"].to_numpy()[at],
                         "source": rows["source"].to_numpy()[at], "piece": got["piece"],
                         "start_token": got["piece"] * capacity, "n_tokens": got["n"]})


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", shard: int = SHARD, cluster_col: str | None = None) -> DataFrame:
    """Rows of (bin_id, slot, doc_id, source, piece, start_token, n_tokens)."""
    common.arrow_batches(docs.sparkSession)
    given = F.col(cluster_col).cast("string") if cluster_col else F.lit(None).cast("string")
    sizes = measure(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                F.col(text_col).alias("text"), given.alias("given")))
    if cluster_col:
        sizes = sizes.withColumn("cluster", F.col("given"))
    values = ["doc_id", "source", "n_tokens", "cluster"]
    # equal rows are counted and numbered, so that they are dealt apart on any layout
    sizes = sizes.groupBy(*values).agg(F.count(F.lit(1)).alias("c")).select(
        *values, F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("copy"))
    sizes = common.materialize(sizes)
    shards = max(1, -(-sizes.count() // shard))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = pack_shard(rows.astype({"doc_id": "Int64"}), capacity)
        got["bin_id"] += int(key[0]) << 32
        return got

    return (sizes.withColumn("shard", F.pmod(F.xxhash64(*values, "copy"), F.lit(shards)))
            .groupBy("shard").applyInPandas(run, OUT))


@common.register("op9_best_fit_packing")
def op9(spark, sf):
    return pack(common.table(spark, sf, "documents"))

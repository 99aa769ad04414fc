"""Toxicity by maximum-scoring segments.

Tokens are lower-cased words.  Each unit (a word, or a word's first six, five or four
characters) gets a log-odds of occurring in toxic against clean documents under an
informative Dirichlet prior (the unit's share of both classes), and its z-score.
A word scores by its most specific significant unit; all other words score a
small negative constant.  One linear scan finds every maximal-scoring segment
(no prefix or suffix of it scores less than zero, disjoint, none can be
extended).  Scores of segments of clean text follow an extreme-value law: n words hold
``E = K n exp(-lambda s)`` segments of score s or more on average, with lambda and K fitted on
clean documents.  For each of its segments a document has r that score at least as high, and the
Poisson probability of r or more; the least of these is its significance, so every segment counts,
and more passages of a kind never weaken it.  A logistic curve turns it into a probability.

Scale: the classifier is fitted on at most about ``per_class`` labelled documents of
each class (whole texts).  Their units are counted in Spark; only units beyond the
significance bound come to the driver, the strongest ``lexicon`` at most.  Scoring is one pass without a shuffle; a
text is looked up with vectorised hashes and only its lexicon hits are scanned.

Defined results: NULL or word-free texts have no segment and get the score of
a text without evidence; without labels, or with one class only, all scores are
0; contradicting labels of one id count each.  NULL ids are never learned from.
Extra columns of either table are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

U = np.uint64
LOG_FACTORIAL = np.vectorize(lambda r: math.lgamma(r + 1), otypes=[float])
#: bytes of a word's prefixes used as back-off units, longest first
PREFIXES = (6, 5, 4)
LEXICON = 1 << 15
PRIOR = 20.0
SIGNIFICANT = 3.2
OTHER = -0.25
#: segments of a clean text expected for each one that the law of all clean texts gives it
CLUSTERS = 3.0


def _units(column, h) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(doc, [unit hashes: word, prefixes...], starts, ends); a prefix unit of a
    word not longer than the prefix is 0."""
    data, off = tb.string_buffers(column)
    data = tb.LOWER[data]
    doc, s, e = tb.word_spans(data, off, tb.ALNUM_WORDS)
    units = [tb.salted(h(data, s, e), 20)]
    for p in PREFIXES:
        units.append(np.where(e - s > p, tb.salted(h(data, s, np.minimum(s + p, e)), 20 + p), U(0)))
    return doc, units, s, e


def segments(score: np.ndarray, at: np.ndarray, gap: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last word, score) of a sequence of
    ``n`` words that scores ``score`` (> 0) at the places ``at`` and ``gap`` (< 0)
    elsewhere; linear in the number of positive places."""
    kept: list[list] = []  # first, last, sum before, sum up to its end
    total = 0.0
    prev = -1
    for x, p in zip(score, at):
        total += gap * (p - prev - 1)
        cur = [int(p), int(p), total, total + x]
        total, prev = total + x, int(p)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= cur[2]:
                j -= 1
            if j < 0 or kept[j][3] >= cur[3]:
                kept.append(cur)
                break
            cur = [kept[j][0], cur[1], kept[j][2], cur[3]]
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r in kept]


class Model:
    """Sorted lexicon hashes with weights, extreme-value and calibration
    parameters."""

    def __init__(self, keys=(), weights=()):
        order = np.argsort(np.asarray(keys, U))
        self.keys, self.weights = np.asarray(keys, U)[order], np.asarray(weights, np.float64)[order]
        self.lam, self.k, self.a, self.b = 1.0, 0.1, 0.0, None

    def weigh(self, units: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(units[0]), np.nan)
        for u in units:
            if not len(self.keys):
                break
            at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            out = np.where(np.isnan(out) & (self.keys[at] == u), self.weights[at], out)
        return out

    def evidence(self, column, h) -> tuple[np.ndarray, list[list]]:
        """Per text: number of words, its segments."""
        doc, units, _, _ = _units(column, h)
        w = self.weigh(units)
        count = np.bincount(doc, minlength=len(column))
        first = np.concatenate([[0], np.cumsum(count)])
        hit = np.flatnonzero(w > 0)
        cut = np.searchsorted(doc[hit], np.arange(len(column) + 1))
        segs = [[] for _ in range(len(column))]
        for i in np.flatnonzero(np.diff(cut)):
            p = hit[cut[i]:cut[i + 1]]
            segs[i] = segments(w[p], p - first[i], OTHER, int(count[i]))
        return count, segs

    def surprise(self, n: float, scores) -> float:
        """-log10 of the least probability, over the segments of a text of ``n`` words, that as many
        score at least as high (0: no segment; 40 at most)."""
        s = np.sort(np.asarray(scores, np.float64))[::-1]
        if not len(s):
            return 0.0
        r = np.arange(1, len(s) + 1)
        e = self.k * max(n, 1) * np.exp(-self.lam * np.minimum(s, 600)) + 1e-300
        fewer = e < r  # else r or more are no surprise
        tail = -e + r * np.log(e) - LOG_FACTORIAL(r) - np.log1p(-np.where(fewer, e / (r + 1), 0))
        logs = np.where(fewer, np.minimum(tail, 0), 0.0)
        logs[0] = np.log(max(-np.expm1(-e[0]), 1e-300))  # one segment: exact
        return float(min(-logs.min() / np.log(10), 40))

    def probability(self, n: np.ndarray, scores: list) -> np.ndarray:
        if self.b is None:
            return np.zeros(len(n))
        z = np.array([self.surprise(a, s) for a, s in zip(n, scores)])
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * z, -30, 30)))

    def calibrate(self, n: np.ndarray, scores: list, y: np.ndarray) -> None:
        """Fit on the words, segment scores and labels of the texts."""
        clean, words = y == 0, max(1.0, float(n[y == 0].sum()))
        hits = np.concatenate([*(np.asarray(s, np.float64) for s, c in zip(scores, clean) if c), np.empty(0)])
        if clean.all() or not clean.any():
            return
        # exponential law of the clean segments above their median; clean texts differ, so theirs come in clusters
        s0 = float(np.median(hits)) if len(hits) else 0.0
        beyond = hits[hits > s0] - s0
        self.lam = float(np.clip(1 / max(beyond.mean(), 1e-6), 0.05, 20)) if len(beyond) else 1.0
        self.k = float(CLUSTERS * max(len(beyond), 1) * np.exp(min(self.lam * s0, 50)) / words)
        z = np.array([self.surprise(a, s) for a, s in zip(n, scores)])
        a, b = 0.0, 0.1  # logistic regression on one feature: Newton steps with a small ridge
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
            r, w = y - p, p * (1 - p) + 1e-9
            g = np.array([r.sum(), (r * z).sum()]) - 1e-2 * np.array([a, b])
            hm = np.array([[w.sum(), (w * z).sum()], [(w * z).sum(), (w * z * z).sum()]]) + 1e-2 * np.eye(2)
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(hm, g), -2, 2)
        self.a, self.b = float(a), float(max(b, 0.0))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, lexicon: int = LEXICON, mod: int = 4,
          out: int = 2) -> Model:
    """Learn from labelled rows whose crc32(id) mod ``mod`` is not ``out``; at
    most about ``per_class`` documents of each class, taken by a hash of the id
    (the bound that lets their ids be broadcast to the texts)."""
    common.arrow_batches(docs.sparkSession)
    known = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(common.crc_mod("doc_id", mod) != out)
             .select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct())
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model()
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    some = known.where(part < share).limit(4 * per_class)
    text = common.materialize(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic"))

    def scan(batches):
        h = tb.WordHash(0)
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                doc, units, _, _ = _units(piece.column(1), h)
                toxic = piece.column(2).to_numpy(zero_copy_only=False)[doc] == 1
                key = np.concatenate([np.zeros(len(doc), U), *units])  # unit 0: all texts with a word
                mark = np.concatenate([np.ones(len(doc), bool), *[x != 0 for x in units]])
                both, key, of = (np.tile(x, 1 + len(units))[mark] if len(x) == len(doc) else x[mark] for x in (toxic, key, doc))
                _, once = np.unique(tb.mix(key + tb.mix(of.astype(U))), return_index=True)  # each unit once a text
                both, key = both[once], key[once]
                u, inv = np.unique(key, return_inverse=True)
                t = np.bincount(inv, weights=both, minlength=len(u)).astype(np.int64)
                c = np.bincount(inv, minlength=len(u)).astype(np.int64) - t
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(u)), pa.array(t), pa.array(c)], names=["unit", "t", "c"])

    counts = (text.mapInArrow(scan, "unit long, t long, c long")
              .groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 3 OR unit = 0"))
    counts = common.materialize(counts)
    total = counts.where("unit = 0").first()
    if total is None or not total["t"] or not total["c"]:
        return Model()
    big_t, big_c = float(total["t"]), float(total["c"])
    t, c = F.col("t"), F.col("c")
    prior = (t + c) * (PRIOR / (big_t + big_c)) + 0.5
    odds = (F.log((t + prior) / (big_t + PRIOR - t - prior)) - F.log((c + prior) / (big_c + PRIOR - c - prior)))
    z = odds / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    top = (counts.where("unit <> 0").select("unit", odds.alias("w"), z.alias("z")).where((F.col("z") > SIGNIFICANT) & (F.col("w") > 1.5))
           .orderBy(F.desc("z"), "unit").limit(lexicon).toPandas())
    model = Model(top["unit"].to_numpy(np.int64).view(U), top["w"].to_numpy(np.float64))

    def measure(batches):
        h = tb.WordHash(0)
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                n, segs = model.evidence(piece.column(1), h)
                flat = [np.array([x[2] for x in g], np.float64) for g in segs]
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), piece.column(2), tb.ragged(flat, np.float64)], names=["n", "toxic", "segs"])

    seen = text.mapInArrow(measure, "n long, toxic int, segs array<double>").toPandas()
    model.calibrate(seen["n"].to_numpy(np.float64), list(seen["segs"]), seen["toxic"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, score, evidence (summed segment scores) and
    segments (first word, last word, score)."""
    common.arrow_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def scan(batches):
        h = tb.WordHash(0)
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                n, segs = model.evidence(piece.column(1), h)
                scores = [[x[2] for x in g] for g in segs]
                found = pa.array([[{"first": a, "last": b, "score": x} for a, b, x in g] for g in segs], kind)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n.astype(np.int64)),
                                                  pa.array(model.probability(n, scores)), pa.array([float(sum(x)) for x in scores], pa.float64()), found],
                                                 names=["doc_id", "n_words", "score", "evidence", "segments"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, score double, evidence double, "
                                 "segments array<struct<first:int,last:int,score:double>>")


@common.register("op7_toxicity")
def op7(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = score(docs, train(docs, common.table(spark, sf, "labels")))
    return got.select("doc_id", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))

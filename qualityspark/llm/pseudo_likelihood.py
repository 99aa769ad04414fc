"""LM scoring by masked pseudo-likelihood.

A small network sees the ``WINDOW`` words on both sides of a place, but not the word
itself, and predicts it: position-wise embeddings of the neighbours are added,
squashed and mapped to the vocabulary.  A document's score is the sum of the
conditional log-probabilities of all its words.

The vocabulary is every word of the corpus.  The most frequent words are classes of their
own; all others share ``RARE`` classes by hash, and such a word's probability is that of its
class times its share of the class, log(count / class count), so every word has
its own.  The network is trained in numpy where the
data are: in every round each partition starts from the current parameters, makes
Adam steps over its own documents, and the parameters are averaged, weighted by
the number of trained places.  A round takes every ``stride``-th place of each document,
the next round the next phase; by default the rounds cover all phases, so every
place is a target.

Scale: word counts are combined per task before one shuffle; a round moves one
parameter vector of fixed size per partition and averages it in Spark, so the
driver holds one vector only.  Scoring looks up the words above a count threshold (at most
``LEXICON``) in place; all rarer ones get their counts by a join on the word, in
which no word is hot.

Defined results: a word the counts have not seen is scored like one seen once; NULL or word-free texts have no words, log_prob 0 and a NULL mean;
an empty table trains nothing and gives no rows; repeated rows count in training
and are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

U = np.uint64
WINDOW = 2
FREQUENT = 191
RARE = 64
LEXICON = 1 << 18
CLASSES = 1 + FREQUENT + RARE  # class 0 is the outside of a text
HIDDEN = 16
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
SHAPES = [(len(OFFSETS), CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
SIZE = sum(int(np.prod(s)) for s in SHAPES)


def split(flat: np.ndarray) -> list[np.ndarray]:
    """Views of a parameter vector: neighbour embeddings, hidden bias, output weights, output bias."""
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(flat[at:at + n].reshape(s))
        at += n
    return out


class Vocabulary:
    def __init__(self, frequent: np.ndarray, counts: DataFrame | None = None):
        """``frequent``: word hashes, most frequent first; ``counts``: (word, n)
        of all words."""
        self.order = np.argsort(frequent)
        self.keys = frequent[self.order]
        self.known, self.log_n = np.empty(0, U), np.empty(0, np.float64)
        self.class_log = np.zeros(CLASSES, np.float64)
        self.tail = None  # (word, n) of words beyond the lexicon; those seen once add log 1
        if counts is not None:
            self._count(counts)

    def __getstate__(self):
        return self.__dict__ | {"tail": None}

    def _count(self, counts: DataFrame) -> None:
        sizes = {r["b"]: r["w"] for r in counts.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count(F.lit(1)).alias("w")).collect()}
        least, held = 63, 0  # words of at least 2 ** least go into the lexicon
        while least and held + sizes.get(least, 0) <= LEXICON:
            held += sizes.get(least, 0)
            least -= 1
        top = counts.where(F.col("n") >= 1 << least).toPandas()
        words = top["word"].to_numpy(np.int64).view(U)
        order = np.argsort(words)
        n = top["n"].to_numpy(np.float64)[order]
        self.known, self.log_n = words[order], np.log(n)
        total = np.zeros(CLASSES, np.float64)
        shared = F.shiftrightunsigned("word", 40) % RARE
        rest = counts.where(~F.col("word").isin(tb.signed(self.keys).tolist()))
        for r in rest.groupBy(shared.alias("c")).agg(F.sum("n").alias("n")).collect():
            total[1 + FREQUENT + r["c"]] = r["n"]
        self.log_n[np.isin(self.known, self.keys)] = 0.0  # a class of its own
        self.class_log = np.log(np.maximum(total, 1))
        if least:
            self.tail = rest.where((F.col("n") > 1) & (F.col("n") < 1 << least))

    def shares(self, words: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log(count / class count) of each word, with count 1 for words beyond the
        lexicon; which words those are (words that are classes are not)."""
        out = -self.class_log[cls]
        if not len(self.known):
            return out, cls > FREQUENT
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        found = self.known[at] == words
        return out + np.where(found, self.log_n[at], 0.0), ~found & (cls > FREQUENT)

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = (1 + FREQUENT + (words >> U(40)) % U(RARE)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            out = np.where(self.keys[at] == words, 1 + self.order[at], out)
        return out


def words_of(column, h: tb.WordHash) -> tuple[np.ndarray, np.ndarray]:
    data, off = tb.string_buffers(column)
    data = tb.LOWER[data]
    doc, s, e = tb.word_spans(data, off, tb.ALNUM_WORDS)
    return doc, h(data, s, e)


def contexts(doc: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Neighbour classes (places x offsets); 0 beyond the text's ends."""
    n = len(cls)
    out = np.zeros((n, len(OFFSETS)), np.int64)
    for k, o in enumerate(OFFSETS):
        if abs(o) < n:
            here, there = (slice(0, n - o), slice(o, n)) if o > 0 else (slice(-o, n), slice(0, n + o))
            out[here, k] = np.where(doc[here] == doc[there], cls[there], 0)
    return out


def forward(par: list[np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and logits."""
    emb, b1, w2, b2 = par
    h = emb[0].take(ctx[:, 0], axis=0)
    for k in range(1, len(OFFSETS)):
        h += emb[k].take(ctx[:, k], axis=0)
    h += b1
    np.tanh(h, out=h)
    z = h @ w2
    z += b2
    return h, z


def log_probs(par: list[np.ndarray], ctx: np.ndarray, target: np.ndarray, block: int = 512) -> np.ndarray:
    out = np.empty(len(target), np.float64)
    reach = np.abs(par[2]).sum(axis=0).max() + np.abs(par[3]).max()  # |h| <= 1
    for i in range(0, len(target), block):
        _, z = forward(par, ctx[i:i + block])
        if reach > 60:
            z -= z.max(axis=1, keepdims=True)
        picked = z[np.arange(len(z)), target[i:i + block]]
        np.exp(z, out=z)
        out[i:i + block] = picked - np.log(z.sum(axis=1))
    return out


def train_places(flat: np.ndarray, batches, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """Adam steps over (contexts, targets) minibatches."""
    flat = flat.copy()
    m, v, step, seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for ctx, target in batches:
        emb, b1, w2, b2 = par = split(flat)
        h, z = forward(par, ctx)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        p /= len(p)
        dh = (p @ w2.T) * (1 - h * h)
        grad = np.zeros_like(flat)
        g = split(grad)
        g[3][:], g[2][:], g[1][:] = p.sum(0), h.T @ p, dh.sum(0)
        for k in range(len(OFFSETS)):
            for d in range(HIDDEN):
                g[0][k, :, d] = np.bincount(ctx[:, k], weights=dh[:, d], minlength=CLASSES)
        step, seen = step + 1, seen + len(target)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        flat -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return flat, seen


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, word being a 64-bit hash."""
    def merge(parts):
        k = np.concatenate([p[0] for p in parts])
        u, inv = np.unique(k, return_inverse=True)
        return u, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)

    def scan(batches):
        h, held = tb.WordHash(0), [(np.empty(0, U), np.empty(0, np.int64))]
        for batch in batches:
            for part in tb.slices(batch, "text"):
                held.append(np.unique(words_of(part.column(0), h)[1], return_counts=True))
                if sum(len(p[0]) for p in held[1:]) > max(500_000, len(held[0][0])):
                    held = [merge(held)]
        u, n = merge(held)
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(u[i:i + 100_000])), pa.array(n[i:i + 100_000])], names=["word", "n"])

    return docs.select("text").mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, rounds: int = 2, stride: int = 2, minibatch: int = 2048) -> tuple[Vocabulary, np.ndarray]:
    common.arrow_batches(docs.sparkSession)
    counts = common.materialize(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    vocab = Vocabulary(top["word"].to_numpy(np.int64).view(U), counts)
    rng = np.random.default_rng(1)
    flat = np.zeros(SIZE, np.float32)
    for part in split(flat)[0], split(flat)[2]:
        part[:] = rng.normal(0, 0.1, part.shape)
    seen = top["n"].to_numpy(np.float64)
    if len(seen):
        split(flat)[3][1:1 + len(seen)] = np.log(seen / seen.sum())

    def local(batches, start: np.ndarray, phase: int):
        h = tb.WordHash(0)

        def places():
            held = []
            for batch in batches:
                for part in tb.slices(batch, "text"):
                    doc, w = words_of(part.column(0), h)
                    cls = vocab.classes(w)
                    first = np.searchsorted(doc, doc)
                    at = np.flatnonzero((np.arange(len(doc)) - first) % stride == phase)
                    held.append((contexts(doc, cls)[at], cls[at]))
                    if sum(len(x[1]) for x in held) >= minibatch:
                        ctx, tgt = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                        full = len(tgt) // minibatch * minibatch
                        for i in range(0, full, minibatch):
                            yield ctx[i:i + minibatch], tgt[i:i + minibatch]
                        held = [(ctx[full:], tgt[full:])]
            held = [x for x in held if len(x[1])]
            if held:
                yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])

        got, n = train_places(start, places())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([got.tolist()], pa.list_(pa.float32()))], names=["n", "par"])

    for r in range(rounds):
        def scan(batches, start=flat, phase=r % stride):
            yield from local(batches, start, phase)

        parts = docs.select("text").mapInArrow(scan, "n long, par array<float>")
        mean = (parts.select("n", F.posexplode("par").alias("i", "x")).groupBy("i")
                .agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x")).toPandas())
        if len(mean):
            flat = mean.sort_values("i")["x"].to_numpy(np.float32)
    return vocab, flat


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, log_prob (summed) and mean_log_prob."""
    common.arrow_batches(docs.sparkSession)
    vocab, flat = model

    def scan(batches):
        h, par = tb.WordHash(0), split(flat)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                doc, w = words_of(part.column(2), h)
                cls = vocab.classes(w)
                n = np.bincount(doc, minlength=part.num_rows)
                share, beyond = vocab.shares(w, cls)
                total = np.bincount(doc, weights=log_probs(par, contexts(doc, cls), cls) + share, minlength=part.num_rows)
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc[beyond], minlength=part.num_rows))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cut), pa.array(tb.signed(w[beyond])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)),
                                                  pa.array(total.astype(np.float64)), rare],
                                                 names=["uid", "doc_id", "n_words", "log_prob", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    got = rows.mapInArrow(scan, "uid long, doc_id long, n_words long, log_prob double, rare array<long>")
    if vocab.tail is not None:
        got = common.materialize(got)
        more = (got.select("uid", F.explode("rare").alias("word")).join(vocab.tail, "word")
                .groupBy("uid").agg(F.sum(F.log("n")).alias("more")))
        got = got.join(more, "uid", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return got.select("doc_id", "n_words", "log_prob",
                      F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


@common.register("op3_pseudo_likelihood")
def op3(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    return score(docs, train(docs))

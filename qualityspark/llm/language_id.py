"""Language identification by error-correcting output codes.

Every learned language gets a codeword of bits.  One binary character n-gram
classifier per bit (logistic, on hashed byte 3-grams and 4-grams of the lower-cased
letters) predicts that bit; loss-weighted decoding adds up each bit's logistic
loss against every codeword, weighted by how well the bit was learned, and
picks the codeword of least loss.  A small distance between the best two
codewords, or a large one to the nearest, marks the answer as ambiguous.

Scale: labels are counted over all training rows; the classifiers are fitted in
numpy on at most ``per_language`` documents of each language (whole texts, taken
by a hash of id and text); the prediction is one pass over the texts with a model of
fixed size, without a shuffle.  Long texts are worked through in pieces, so
memory does not grow with a text.

Defined results: NULL text or a text without a letter gives ``und`` with score
0; without any training label every text gives ``und``; with a single language
every other text gives that one.  Ties between codewords go to the smaller
language name.  A NULL id is not held out and not learned from.  Extra columns
are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

U32 = np.uint32
BUCKETS = 1 << 13
#: bytes of one piece while n-grams are hashed
PIECE = 1 << 19
LETTER = tb.byte_class((0x61, 0x7A), (0x80, 0xFF))


def codewords(k: int) -> np.ndarray:
    """k x bits matrix of +-1.  Up to 6 classes: the exhaustive code (every
    split of the classes once); beyond that the best of several fixed random
    codes of about 10 log2(k) bits, by smallest distance between two words."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        rows = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << k, 2)
                if c != (1 << k) - 1]
        return np.array(rows, np.float32).T
    bits, best = int(10 * np.ceil(np.log2(k))), None
    for seed in range(20):
        m = np.where(np.random.default_rng(seed).random((k, bits)) < 0.5, -1, 1).astype(np.float32)
        gap = min(int((a != b).sum()) for a, b in itertools.combinations(m, 2))
        if best is None or gap > best[0]:
            best = (gap, m)
    return best[1]


def _letters(data: np.ndarray, before: int) -> np.ndarray:
    """Lower-cased bytes with every run of non-letters as one space;
    ``before`` is the byte in front of the piece."""
    low = tb.LOWER[data]
    prev = np.empty_like(data)
    prev[0], prev[1:] = before, data[:-1]
    low = low + ((prev == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)).astype(np.uint8) * np.uint8(32)
    ok = LETTER[low]
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    keep[0] |= LETTER[tb.LOWER[before]]
    low[~ok] = 0x20
    return low[keep]


def _hash_grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 3-grams and 4-grams starting at each place."""
    y = x.astype(U32)
    three = (y[:-2] * U32(0x9E3779B1) ^ y[1:-1] * U32(0x85EBCA77)) * U32(0x27D4EB2F) ^ y[2:] * U32(0xC2B2AE3D)
    four = (three[:-1] * U32(0x165667B1)) ^ y[3:] * U32(0x9E3779B1)
    spread = lambda h: ((h ^ (h >> U32(15))) * U32(0x2C1B3C6D)) >> U32(20)  # noqa: E731  12 bits each
    return spread(three), spread(four) + U32(BUCKETS // 2)


def gram_counts(text: bytes) -> np.ndarray:
    """Bucket counts of a whole text."""
    data, out, tail, before = np.frombuffer(text, np.uint8), np.zeros(BUCKETS, np.int64), b" ", 0
    counted = 0  # 3-grams of the tail that are counted already
    for i in range(0, len(data), PIECE):
        piece = data[i:i + PIECE]
        x = np.concatenate([np.frombuffer(tail, np.uint8), _letters(piece, before)])
        before = int(piece[-1])
        if len(x) >= 4:
            three, four = _hash_grams(x)
            out += np.bincount(three[counted:], minlength=BUCKETS)
            out += np.bincount(four, minlength=BUCKETS)
            tail, counted = x[-3:].tobytes(), 1
        else:
            tail = x.tobytes()
    return out


def has_letter(texts) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)


def _features(c: np.ndarray) -> np.ndarray:
    f = np.sqrt(c, dtype=np.float32)
    return f / max(float(np.sqrt((f * f).sum())), 1e-6)


class EcocModel:
    """Codewords, bit classifiers and bit weights."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray, steps: int = 150):
        self.langs, self.codes = langs, codewords(len(langs))
        k, bits = self.codes.shape if len(langs) else (0, 1)
        self.w, self.b, self.bit_weight = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32)
        if k < 2 or not len(x):
            return
        t = (self.codes[y] + 1) / 2
        weight = (1.0 / np.bincount(y, minlength=k))[y].astype(np.float32)[:, None]
        weight /= weight.sum()
        vw, vb, rate = np.zeros_like(self.w), np.zeros_like(self.b), 40.0
        for _ in range(steps):  # full-batch gradient with momentum
            p = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
            g = (p - t) * weight
            vw = 0.9 * vw - rate * (x.T @ g + 1e-4 * self.w / bits)
            vb = 0.9 * vb - 0.1 * g.sum(0)
            self.w += vw.astype(np.float32)
            self.b += vb.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
        loss = -(weight * (t * np.log(p + 1e-6) + (1 - t) * np.log(1 - p + 1e-6))).sum(0)
        self.bit_weight = (1 / (0.1 + loss)).astype(np.float32)
        self.bit_weight /= self.bit_weight.sum()

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) for rows of features."""
        margin = f @ self.w + self.b
        loss = (np.logaddexp(0, -margin[:, None, :] * self.codes[None]) * self.bit_weight).sum(2)
        best = loss.argmin(1)
        e = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        score = e[np.arange(len(f)), best] / e.sum(1)
        wrong = ((np.sign(margin) != self.codes[best]) * self.bit_weight).sum(1)
        return best, score, (score < 0.6) | (wrong > 0.25)


def train(docs: DataFrame, per_language: int = 512, mod: int = 5) -> EcocModel:
    """Fit on at most about ``per_language`` documents per language among the
    rows whose crc32(id) mod ``mod`` is not 0.  The bound is what keeps the
    fit on the driver small; label counts are taken over all rows."""
    common.arrow_batches(docs.sparkSession)
    pool = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(common.crc_mod("doc_id", mod) != 0)
    sizes = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return EcocModel([], np.empty((0, BUCKETS), np.float32), np.empty(0, np.int64))
    if len(langs) > 2000:
        raise ValueError(f"{len(langs)} languages: lang must be a label column")
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    some = pool.where(part < F.try_element_at(share, F.col("lang")))

    def scan(batches):
        for batch in batches:
            idx, val = [], []
            for t in batch.column(1):
                c = gram_counts(t.as_py().encode())
                at = np.flatnonzero(c)
                idx.append(at.astype(np.uint16).tobytes())
                val.append(_features(c)[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                                             names=["lang", "idx", "val"])

    rows = (some.select("lang", "text").mapInArrow(scan, "lang string, idx binary, val binary")
            .limit(2 * per_language * len(langs)).toPandas().sort_values(["lang", "idx", "val"], ignore_index=True))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(rows["idx"], rows["val"])):
        x[i, np.frombuffer(a, np.uint16)] = np.frombuffer(b, np.float32)
    y = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64)
    seen = np.unique(y)  # a language may have no row in the sample only if all of its texts hash out
    y = np.searchsorted(seen, y)
    return EcocModel([langs[i] for i in seen], x, y)


def _predicted(docs: DataFrame, model: EcocModel) -> DataFrame:
    """``docs`` plus ``__lang``: lang_pred, score, ambiguous."""
    common.arrow_batches(docs.sparkSession)
    names = np.array([*model.langs, "und"], dtype=object)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts):
        import pandas as pd
        arr = pa.Array.from_pandas(texts, type=pa.string())
        ok = has_letter(arr) if len(model.langs) else np.zeros(len(arr), bool)
        best, score, odd = np.full(len(arr), len(names) - 1), np.zeros(len(arr)), np.ones(len(arr), bool)
        at = np.flatnonzero(ok)
        for i in range(0, len(at), 256):
            rows = at[i:i + 256]
            f = np.stack([_features(gram_counts(texts.iloc[r].encode())) for r in rows])
            best[rows], score[rows], odd[rows] = model.decode(f)
        return pd.DataFrame({"lang_pred": names[best], "score": score, "ambiguous": odd})

    return docs.withColumn("__lang", predict(F.col("text")))


def identify(docs: DataFrame, model: EcocModel) -> DataFrame:
    """The id column doc_id plus lang_pred, lang_score and lang_ambiguous."""
    got = _predicted(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.col("__lang.lang_pred").alias("lang_pred"),
                      F.col("__lang.score").alias("lang_score"), F.col("__lang.ambiguous").alias("lang_ambiguous"))


def keep_identified(docs: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` whose language was decided: neither ``und`` nor
    ambiguous with less than half of the score for the nearest codeword."""
    got = _predicted(docs, train(docs, **kw))
    return got.where("__lang.lang_pred <> 'und' AND NOT (__lang.ambiguous AND __lang.score < 0.5)").select(*docs.columns)


@common.register("op1_language_id")
def op1(spark, sf):
    docs = common.table(spark, sf, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    got = identify(docs, model)
    return got.select("doc_id", F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))

"""Secret scan with corpus-wide ownership frequency.

Base spans come from three fixed patterns (assignments, access keys, long hex
runs).  The method adds *token* spans: other long runs of key characters that
look random (letters and digits mixed, enough entropy).  Every candidate value
is hashed and the hashes are counted over the whole corpus by distinct
documents (repositories) and distinct sources (owners): a value that several
owners carry is a widely copied example, one that stays with a few owners is an
owner-specific credential, whatever a base span's value looks like.  A token span is added
only if it looks random and is owner-specific; base spans always stay and carry their verdict.

Scale: one scan; documents without a candidate are never shuffled by value.  A
value copied into a third of all documents is first reduced per (value, owner)
and per (value, document) on the map side; verdicts come back by a join that
is salted by document.

Defined results: NULL text is empty; NULL owners count as one owner of their own;
repeated rows are judged one by one, but count as one document if their ids are equal; a
NULL id counts as one document.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common, textbytes as tb

SALT = 16
#: fixed values: kinds in the order of the contract, then the added kind
KINDS = ("assign", "access", "hex", "token")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# fixed values: the base patterns; [0-9a-f]{32,} and AKIA[A-Z0-9]{12,} match what
# the '+' forms match with the required length, because those runs are maximal
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api"))).replace(
    _either("api"), _either("api") + "_?" + _either("key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
TOKEN = re.compile("[A-Za-z0-9_+/=-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    """Mixed, varied and not a placeholder."""
    low = value.lower()
    if any(w in low for w in ("example", "changeme", "xxxx", "your", "dummy", "test")):
        return False
    return len(value) >= 16 and entropy(value) >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(text: str, long_run: bool = True) -> list[tuple[int, int, int, str]]:
    """(kind index, start, end, value) of all base and token candidates."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    if long_run:
        out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
        base = sorted((s, e) for _, s, e, _ in out)
        for m in TOKEN.finditer(text):
            if looks_live(m[0]) and not any(s < m.end() and m.start() < e for s, e in base):
                out.append((3, m.start(), m.end(), m[0]))
    return out


#: run bytes of a token or hex run
RUN = tb.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3D, 0x3D), (0x5F, 0x5F))
DIGIT = tb.byte_class((0x30, 0x39))


def _long_runs(column) -> np.ndarray:
    """Which texts have a run of 20 key characters with a digit (a hex run of 32
    without any digit is such a run too); only those need the run patterns."""
    data, off = tb.string_buffers(column)
    doc, s, e = tb.word_spans(data, off, RUN)
    out = np.zeros(len(column), bool)
    out[doc[e - s >= 20]] = True
    return out


def _scan(docs: DataFrame) -> DataFrame:
    item = "array<struct<kind int, start int, end int, value binary>>".replace(" int", ":int").replace(" binary", ":binary")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))

    def scan(batches):
        for batch in batches:
            for part in tb.slices(batch, "text"):
                runs = _long_runs(part.column(3))
                found = []
                for t, r in zip(part.column(3), runs):
                    t = t.as_py()
                    found.append([{"kind": k, "start": s, "end": e,
                                   "value": hashlib.blake2b(v.encode(), digest_size=16).digest()}
                                  for k, s, e, v in candidates(t, bool(r))] if t else [])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 2, 4)), pa.array(found, kind)],
                                                 names=["uid", "doc_id", "owner", "text_hash", "found"])

    return docs.mapInArrow(scan, f"uid long, doc_id long, owner string, text_hash long, found {item}")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 min_owners: int = 3) -> DataFrame:
    """Per document row: uid (row number of the scan), doc_id, spans: array of
    (start, kind, end, n_docs, n_owners, verdict) sorted by start, then kind.
    verdict: ``example`` (at least ``min_owners`` owners) or ``live``
    (owner-specific)."""
    common.arrow_batches(docs.sparkSession)
    rows = common.materialize(_scan(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("text_hash"))))
    one = (rows.where(F.size("found") > 0).select("uid", "doc_id", "owner", F.explode("found").alias("f"))
           .select("uid", "doc_id", "owner", "f.*"))
    owners = one.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = (one.select("value", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).distinct()
             .groupBy("value").agg(F.count(F.lit(1)).alias("n_docs")))
    freq = owners.join(repos, "value").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    judged = (one.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALT)).cast("int")).join(freq, ["value", "salt"])
              .withColumn("verdict", F.when(F.col("n_owners") >= min_owners, "example").otherwise("live"))
              .where((F.col("kind") < 3) | (F.col("verdict") == "live")))
    spans = judged.groupBy("uid").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "n_docs", "n_owners", "verdict"))).alias("spans"))
    return rows.select("uid", "doc_id", "text_hash").join(spans, "uid", "left")


def _named(where: str = "true"):
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(filter(spans, x -> {where}), x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, mark: str = "<SECRET>", **kw) -> DataFrame:
    """``docs`` with every owner-specific secret replaced by
    ``mark`` (widely copied examples stay).  Rows and columns are kept; n_chars, if
    present, follows the text."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    cols = docs.columns
    text = kw.get("text_col", "text")
    id_col = kw.get("id_col", "doc_id")
    found = scan_secrets(docs, **kw)
    # equal ids and texts have equal spans, so the text's hash identifies the row
    live = (found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
                         F.expr("transform(filter(spans, x -> x.verdict = 'live'), x -> struct(x.start, x.end))").alias("__cut"))
            .where(F.size("__cut") > 0).dropDuplicates(["__id", "__hash"]))
    rest, j = common.split_rows(docs, common.materialize(live), id_col, text)

    @F.pandas_udf("string")
    def replaced(texts, cuts):
        out = []
        for t, c in zip(texts, cuts):
            end, parts = 0, []
            for x in sorted((x["start"], x["end"]) for x in c) if c is not None else ():
                if x[0] >= end:
                    parts += [t[end:x[0]], mark]
                end = max(end, x[1])
            out.append(t if not parts else "".join([*parts, t[end:]]))
        import pandas as pd
        return pd.Series(out, dtype=object)

    got = j.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col("__cut"))))
    if "n_chars" in cols:
        got = got.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(
            docs.schema["n_chars"].dataType))
    return rest.unionByName(got.select(*cols))


@common.register("op6_secret_scan")
def op6(spark, sf):
    got = scan_secrets(common.table(spark, sf, "documents"))
    count = lambda k: F.expr(f"cast(coalesce(size(filter(spans, x -> x.kind = {k})), 0) as long)")
    how = lambda v: F.expr(f"cast(coalesce(size(filter(spans, x -> x.verdict = '{v}')), 0) as long)")
    return (got.withColumn("spans", F.coalesce("spans", F.expr("filter(spans, x -> false)"), F.from_json(F.lit("[]"), got.schema["spans"].dataType)))
            .select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(_named("x.kind < 3"), 256).alias("base_sha256"), _named().alias("span_text"),
                    how("live").alias("n_live"), how("example").alias("n_example"))
            .withColumnRenamed("span_text", "spans"))

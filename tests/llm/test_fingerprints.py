"""Winnowed fingerprints against brute force, and the match guarantee."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from qualityspark.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, m long, marks string"


def signed(text):
    return int.from_bytes(xxhash.xxh64(text.encode(), seed=42).digest(), "big", signed=True)


def brute_marks(text, k, window):
    data = text.encode()
    if not data:
        return []
    n = max(1, len(data) - k + 1)
    h = [(xxhash.xxh64(data[i:i + k], seed=42).intdigest() >> 31) & 0xFFFFFFFF for i in range(n)]
    out = set()
    for j in range(max(1, n - window + 1)):
        low = min(h[j:j + window])
        out.add(max(i for i in range(j, min(j + window, n)) if h[i] == low))
    return [(h[i], i) for i in sorted(out)]


def like(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, k, window):
    docs = sorted({(d is not None, d if d is not None else 0, t or "") for d, t in rows},
                  key=lambda x: (not x[0], -x[1], signed(x[2]), len(x[2])))
    result = {}
    for i, doc in enumerate(docs):
        t, nxt = doc[2], docs[(i + 1) % len(docs)][2]
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        m, me, mn = (brute_marks(x, k, window) for x in (t, e, nxt))
        say = lambda m: ",".join(f"{h:08x}@{p}" for h, p in m)
        result[doc] = (doc[1] if doc[0] else None, len(t), hashlib.sha256(e.encode()).hexdigest(), say(m), say(me), round(like(m, me), 9), round(like(m, mn), 9))
    return sorted((result[(d is not None, d if d is not None else 0, t or "")] for d, t in rows), key=str)


def rows_of():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(60)] + ["été", "日本語", "😀x", "zz"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 120])))) for i in range(40)]
    rows += [(100, rows[5][1]), (101, None), (102, ""), (None, "no id at all, but some text here"), (None, None), (103, "é" * 500), (104, "ab" * 400),
             (100, "other text of the same id"), (105, "x" * 3000 + " tail"), (106, "日")]
    return rows + [(7, rows[7][1])] * 3


@pytest.mark.parametrize("k,window,piece", [(12, 48, 1 << 14), (16, 32, 50), (5, 4, 7), (8, 1, 10), (3, 6, 1)])
def test_fingerprints_match_brute_force(spark, k, window, piece):
    rows = rows_of()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = fp.fingerprints(frame, k=k, window=window, piece=piece).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    got = sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=str)
    assert got == brute(rows, k, window)


def test_single_document_and_none(spark):
    one = fp.fingerprints(spark.createDataFrame([(3, "abcdef" * 20, 1, "x")], SCHEMA)).first()
    t = "abcdef" * 20
    assert one.edited_sha256 == hashlib.sha256((t[:60] + t[:60]).encode()).hexdigest() and one.near_next == 1.0
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_passage_is_seen_at_its_place(spark):
    """A shared run of k + window - 1 bytes always leaves a common hash inside it, and its place."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(30):
        shared, before, after = make(fp.K + fp.WINDOW - 1), rng.randrange(5, 200), rng.randrange(5, 200)
        rows.append((i, make(before) + shared + make(50), make(after) + shared + make(50), before, after))
    frame = spark.createDataFrame(rows, "i int, a string, b string, before int, after int")
    for c in "ab":
        frame = frame.withColumn(f"m{c}", fp.selected(F.encode(c, "UTF-8"), F.octet_length(c)))
    for r in frame.select("before", "after", fp.matches(F.col("ma"), F.col("mb")).alias("at")).collect():
        assert any(r.before <= x.at_a <= r.before + fp.WINDOW - 1 and x.at_a - r.before == x.at_b - r.after for x in r["at"])


def test_texts_move_once(spark):
    """One exchange of texts (reused), no Python in the plan."""
    frame = spark.createDataFrame([(i, "some text %d " % i * 20, 1, "x") for i in range(50)], SCHEMA)
    out = fp.fingerprints(frame)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_windows_of_a_text_are_made_once(spark, monkeypatch):
    """One pass over the windows of a whole text; beside it the last leading window and the edited tail."""
    calls, minima = [], fp.minima
    monkeypatch.setattr(fp, "minima", lambda data, first, last, *cut: calls.append((str(first), str(last))) or minima(data, first, last, *cut))
    frame = spark.createDataFrame([(i, "some text %d " % i * 20, 1, "x") for i in range(5)], SCHEMA)
    fp.fingerprints(frame)
    whole = [c for c in calls if c[0] == "Column<'0'>"]
    assert len(whole) == 1 and len(calls) == 3


def test_leading_marks_are_those_of_the_first_windows(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 20, 60, 200]))), lead) for lead in (0, 1, 2, 9, 40) for _ in range(8)]
    k, window = 3, 4
    rows = [(t, min(lead, max(0, len(t) - k - window + 2))) for t, lead in rows]
    frame = spark.createDataFrame(rows, "t string, lead int").withColumn("d", F.encode("t", "UTF-8"))
    frame = frame.withColumn("marks", fp.selected(F.col("d"), F.octet_length("d"), k, window))
    got = frame.select("marks", fp.marks_at(F.col("d"), fp.places(F.col("marks")), k).alias("again"),
                       fp.leading(F.col("marks"), F.col("d"), F.col("lead"), k, window).alias("head"),
                       fp.minima(F.col("d"), F.lit(0), F.col("lead") - 1, k, window).alias("expected")).collect()
    assert all(r.again == r.marks and r["head"] == r.expected for r in got)

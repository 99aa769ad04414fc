"""Prefix trie against brute force: bands of every height, hot nodes, edge rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from qualityspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, kx long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def signed(h):
    return tuple(int(h[i:i + 16], 16) - (1 << 64 if int(h[i:i + 16], 16) >> 63 else 0) for i in (0, 16))


def brute(rows, step=20, mod=4):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), signed(digest(role, text)), role, text))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    member, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % mod
        seq = own.get(c - c % step, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            member.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for n in member:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out = []
    for n, cs in member.items():
        below = [m for m in member if m[:len(n)] == n]
        saved = sum((len(member[m]) - 1) * (len(SPACE.findall(m[-1][1])) if m else 0) for m in below)
        out.append((min(cs), len(n), min(member[n[:-1]]) if n else None, len(cs), len(kids.get(n, [])), sum(m not in kids for m in below),
                    saved, hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **more):
    bucket = more.pop("bucket", prefix_trie.BUCKET)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    seqs, convs = prefix_trie.rebuilt(frame, F.col("conv_id") - F.col("conv_id") % 20, head, 3, bucket)
    return sorted(map(tuple, prefix_trie.trie(seqs, convs, **more).collect()), key=str)


def conversations():
    rng = random.Random(2)
    rows = []
    for c in range(70):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "d  e\tf"]) if t > 2 else "same start"))
    rows += [(200, t, "user", "deep %d" % (t // 3)) for t in range(40)] + [(220 + i, t, "user", "deep %d" % (t // 3)) for i in (1, 2) for t in range(37)]
    rows += [(77, 0, None, None), (77, None, "user", "first"), (77, 0, None, None), (None, 0, "user", "lost"), (101, 0, "u", "late"),
             (95, 5, "u", "x"), (95, 5, "u", "y"), (95, 5, "t", "x"), (95, None, "", ""), (-21, 0, "u", "minus")]
    return rows


@pytest.mark.parametrize("more", [{}, {"band": 2, "bucket": 3, "piece": 2, "salt": 3}, {"band": 3, "bucket": 7}, {"band": 64}])
def test_trie_matches_brute_force(spark, more):
    rows = conversations()
    assert trie(spark, rows, **more) == brute(rows)


def test_hot_conversation_and_hot_end(spark):
    """Copies of one conversation end at one node; one conversation is much longer than its bucket."""
    rows = [(c, t, "user", "hello there") for c in range(0, 400, 20) for t in range(2)] + [(1000, t, "user", "hello there") for t in range(150)]
    got = trie(spark, rows, bucket=16, piece=4)
    assert got == brute(rows)
    assert max(r[3] for r in got) == 21 and max(r[1] for r in got) == 150


def test_sorted_in_its_own_columns_only(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a")]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "u", "a")]) == []

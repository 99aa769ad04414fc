"""Hard-negative mining against brute force, its R-tree, and edge rows."""

import itertools
import math
import random

import numpy as np
import pytest

from qualityspark.llm import exact, hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, aid string"


def brute(rows, every, positives, negatives, low, high, scale):
    seen = {(i, y, tuple(math.floor(scale * x) for x in v)) for i, v, y in rows
            if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in (r for r in seen if r[0] % every == 0):
        score = lambda u: sum(a * b for a, b in zip(u, v))
        same = {(-score(u), j) for j, z, u in seen if j != i and z == y and len(u) == len(v)}
        other = {(-score(u), j) for j, z, u in seen if j != i and z != y and len(u) == len(v)}
        for ps, p in sorted(same)[:positives]:
            hit = sorted((s, j) for s, j in other if low * -ps <= 100 * -s <= high * -ps)[:negatives]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(hit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(frame, **more).collect()))


def vectors(n, dims, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.4, 1) for _ in range(dims)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("dims,more", [(2, {"tree": 40}), (8, {"tree": 64, "block": 3}), (3, {"positives": 2, "negatives": 3, "low": 10, "high": 70})])
def test_mine_matches_brute_force(spark, monkeypatch, dims, more):
    monkeypatch.setattr(hn.Tree.__init__, "__defaults__", (4, 3))
    rows = vectors(300, dims) + [(300 + i, [1.0] * dims, i % 2) for i in range(60)]  # one very common vector
    full = dict(every=10, positives=5, negatives=10, low=30, high=90, scale=256) | {k: v for k, v in more.items() if k not in ("tree", "block")}
    assert mined(spark, rows, every=10, **more) == brute(rows, **full)


def test_edges(spark):
    rows = vectors(60, 3, 5)
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1010, [1.0, 1.0, 1.0], None), (1020, [1.0, None, 1.0], 1), (1030, [float("nan"), 1.0, 1.0], 1),
             (1040, [float("inf"), 0.0, 0.0], 1), (1050, [], 1), (1060, [], 2), (1070, [2.0, 3.0], 1), (1080, [2.0, 2.5], 1), (1090, [1.0, 1.0], 2)]
    rows += [rows[10], rows[10], rows[13], (10, rows[11][1], 3)]  # repeated rows; one id with two vectors
    full = dict(positives=5, negatives=10, low=30, high=90, scale=256)
    assert mined(spark, rows, every=10) == brute(rows, 10, **full)
    assert mined(spark, [], every=10) == []


def test_large_components_are_exact(spark):
    """Products beyond a double and beyond a long keep their order and, within a long, their value."""
    rng = random.Random(3)
    rows = vectors(40, 2, 8)
    rows += [(100 + i, [rng.choice([1e6, 3e6, 3e6 + 1]), rng.uniform(0, 5)], i % 2) for i in range(30)]
    got, want = mined(spark, rows, every=10), brute(rows, 10, 5, 10, 30, 90, 256)
    assert got == want and any(abs(r[4]) > 1 << 53 for r in want)
    rows += [(200 + i, [rng.choice([1e13, 2e13, 5e12]), 1.0], i % 2) for i in range(30)]
    got, want = mined(spark, rows, every=10), brute(rows, 10, 5, 10, 30, 90, 256)
    cut = lambda s: max(-exact.LONG - 1, min(exact.LONG, s))
    assert got == sorted((*r[:4], cut(r[4]), cut(r[5])) for r in want) and any(r[4] > exact.LONG for r in want)


def test_tree_bounds_and_pruning():
    """Boxes bound every inner product, and a search opens few leaves where boxes are tight."""
    rng = np.random.default_rng(0)
    mat = np.floor(rng.normal(0, 100, (3000, 2)))
    order = hn.str_order(mat, 16)
    assert sorted(order) == list(range(3000))
    tree = hn.Tree(order.astype(np.int64), np.zeros(3000, np.int64), mat[order], 16, 4)
    q = np.floor(rng.normal(0, 100, (20, 2)))
    bounds = tree.bounds(q)
    opened = 0
    for a in range(20):
        scores = tree.mat @ q[a]
        for leaf in range(len(tree.low[0])):
            s = scores[leaf * 16:(leaf + 1) * 16]
            assert bounds[0][0][a][leaf] <= s.min() and s.max() <= bounds[0][1][a][leaf]
        best = hn.Best(5)

        def found(s, e):
            nonlocal opened
            opened += 1
            best.add(scores[s:e].astype(np.int64), tree.ids[s:e])

        tree.visit(bounds, a, lambda low, high: best.bar() is None or high >= best.bar(), found)
        assert best.rows == sorted(((int(s), int(i)) for s, i in zip(scores, tree.ids)), key=lambda r: (-r[0], r[1]))[:5]
    assert opened < 20 * len(tree.low[0]) / 8


def test_exact_pairs_choose_a_safe_kind():
    for top, kind in ((10, float), (1e9, np.int64), (1e30, object)):
        a, b = exact.pair(np.array([[top, 1.0]]), np.array([[top, 2.0]]))
        assert a.dtype == kind and (a @ b.T)[0, 0] == int(top) ** 2 + 2
    for s in (0, exact.LONG, -exact.LONG - 1, 10 ** 100, -10 ** 100):
        (long,), (big,) = exact.shown([s])
        assert exact.read(long, big) == s
    texts = [exact.shown([s])[1][0] for s in sorted([10 ** 80, -10 ** 80, 1 << 63, -1 << 70])]
    assert texts == sorted(texts) and len(list(itertools.chain(texts))) == 4

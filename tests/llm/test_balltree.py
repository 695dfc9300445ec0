import math
import random

import numpy as np

from trackloom.llm import balltree as B


def brute(rows, k, every):
    good = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {r for r in good if r[0] % every == 0}:
        others = list(good)
        others.remove((q, v))
        scores = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in others if len(x) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_ROWS", 40)
    monkeypatch.setattr(B, "BLOCK_ROWS", 7)
    monkeypatch.setattr(B, "LEAF", 8)
    monkeypatch.setattr(B, "WAVES", (1, 2, None))
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(500)]
    rows += [(i, [0.25] * 6) for i in range(500, 800)]
    rows += [(1000, [0.5] * 3), (1001, [1.0, 2.0, 3.0]), (1010, [0.0, 1.0, 0.0]), (1020, None), (1030, []), (1040, [None] * 6), (1050, [float("nan")] * 6), (1060, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (-20, [-0.3] * 6), (5, rows[5][1]), (10, [0.9] * 6), (2000, [1.0])]
    rows += [(30, rows[30][1])] * 2 + [(790, [0.25] * 6)] * 8  # repeated query rows, of a frequent vector too
    data = spark.createDataFrame([(*r, 1, [2]) for r in rows], "vec_id long, embedding array<float>, score int, v array<int>").repartition(4)
    got = sorted(tuple(r) for r in B.top_k(data, 5, 10).collect())
    assert got == brute(rows, 5, 10)
    assert B.top_k(data.limit(0)).count() == 0


def test_bounds_cut_what_is_shipped(spark, monkeypatch):
    """Of queries x shards only those are shipped whose bound reaches the kth score."""
    monkeypatch.setattr(B, "SHARD_ROWS", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (32, 3))
    v = np.repeat(centres, 64, 0) + rng.normal(0, 0.02, (2048, 3))
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    rows = B.quantised(data, "vec_id", "embedding", 256)
    asks = rows.where("id % 16 = 0").select("dim", "v").distinct()
    shipped = []
    monkeypatch.setattr(B, "cut", lambda df, f=B.cut: shipped.append(df) or f(df))
    got = B.search(rows, asks, 5)
    n = asks.count()
    plans = [str(d._jdf.queryExecution().optimizedPlan()) for d in shipped]
    assert got.count() == 5 * n and sum("Join" in p for p in plans) == 3
    waves = []
    real = B.Tree.search
    trees = {r.shard: __import__("pickle").loads(r.tree) for r in next(d for d in shipped if "tree" in d.columns).collect()}
    for q in [r.v for r in asks.collect()]:
        q, best, asked = np.array([q]), (np.full(1, -np.inf), np.full(1, 1 << 62)), 0
        bound = {s: float(B.upper_bound((q @ t.levels[0][0].T)[0], np.sqrt((q * q).sum(1)), t.levels[0][1])[0]) for s, t in trees.items()}
        kth = sorted(r for t in trees.values() for r in real(t, q, 5, *best)[2].tolist())[-5]
        waves.append(sum(b >= kth for b in bound.values()))
    assert np.mean(waves) < 0.35 * len(trees)


def test_large_integers():
    rng = np.random.default_rng(1)
    v = rng.integers(-(1 << 30), 1 << 30, (200, 4))
    tree = B.Tree(np.arange(200), v)
    q = v[:5]
    own, ids, s = tree.search(q, 3, np.full(5, -np.inf), np.full(5, 1 << 62))
    for i in range(5):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x, strict=True)), j) for j, x in enumerate(v))[:3]
        assert [(-int(a), int(b)) for a, b in zip(s[own == i], ids[own == i], strict=True)] == want


def test_branch_and_bound_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (40, 4))
    v = np.rint(np.repeat(centres, 50, 0) + rng.normal(0, 3, (2000, 4))).astype(np.int64)
    tree = B.Tree(np.arange(2000), v)
    calls = []

    class Counted(list):
        def __getitem__(self, i):
            calls.append(i)
            return list.__getitem__(self, i)

    tree.parts = Counted(tree.parts)
    tree.search(v[:1], 5, np.full(1, -np.inf), np.full(1, 1 << 62))
    assert 0 < len(calls) < len(tree.parts) / 3

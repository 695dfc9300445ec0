import hashlib
import random

import numpy as np

from trackloom.llm import substrings as D


def brute(rows, length=50):
    seen = {}
    for doc, text in rows:
        b = (text or "").encode()
        if doc is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                seen[w] = min(doc, seen.get(w, doc))
    drop = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            if doc is not None and seen[b[i : i + length]] < doc:
                drop.setdefault(doc, set()).update(range(i, i + length))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = {i for i in drop.get(doc, ()) if i < len(b)}
        left = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((doc, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def texts(rnd):
    words = ["alpha", "beta", "gamma", "é", "of", "the", "of the", "x" * 30]
    shared = [" ".join(rnd.choices(words, k=rnd.randint(6, 40))) for _ in range(8)]
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) - 1)
            parts.append(s[a : a + rnd.randint(45, 60)] if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(1, 30))))
        yield "".join(parts)


def test_anchors_own_each_window_once():
    rnd = random.Random(2)
    for _ in range(20):
        docs = [bytes(rnd.choices(b"ab c", k=rnd.choice([0, 10, 49, 50, 51, 300]))) for _ in range(6)]
        at = np.cumsum([0, *map(len, docs)])
        h, t, f, g = D.anchors(at, np.frombuffer(b"".join(docs), np.uint8), 50)
        owned = sorted(p for a, b in zip(f, g, strict=True) for p in range(a, b + 1))
        assert owned == [at[i] + p for i, d in enumerate(docs) for p in range(len(d) - 49)]


def test_windows_against_brute_force():
    rnd = random.Random(4)
    contexts = sorted({t.encode() for t in texts(rnd) if len(t.encode()) >= 50})
    least = np.array([rnd.randint(0, 50) for _ in contexts])
    first, at = D.first_documents(contexts, least, 50)
    best = {}
    for c, n in zip(contexts, least.tolist(), strict=True):
        for i in range(len(c) - 49):
            best[c[i : i + 50]] = min(n, best.get(c[i : i + 50], n))
    assert first.tolist() == [best[c[i : i + 50]] for c in contexts for i in range(len(c) - 49)] and at[-1] == len(first)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 3000)
    rnd = random.Random(7)
    rows = [(i * 3, t) for i, t in enumerate(texts(rnd))]
    long = "".join(rnd.choices("abc d", k=40000))
    rows += [(500, long), (501, "zz" + long[100:39000]), (502, "a" * 400), (503, "b" + "a" * 200), (600, None), (601, ""), (None, long[:500]), (6, rows[2][1]), (6, long[:300]), (505, "q" * 49), (506, "q" * 49)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, start int, context string").repartition(5)
    assert got_of(D.dedup(docs)) == brute(rows)
    assert D.dedup(docs.limit(0)).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_of(D.dedup(docs)) == brute(rows)

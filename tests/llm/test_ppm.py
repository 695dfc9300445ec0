import math
import random
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import ppm as P
from trackloom.llm import queries
from trackloom.llm.common import ASCII_LOWER


def bytes_of(text):
    return (text or "").encode()


def plain_model(texts, order):
    """Contexts as dicts, walked symbol by symbol."""
    trie = {}
    for t in texts:
        s = b"\xff" * order + bytes_of(t) + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                trie.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def log10(text):
        s, out = b"\xff" * order + bytes_of(text) + b"\xff", 0.0
        for i in range(order, len(s)):
            shut, p = set(), 1.0
            for k in range(order, -1, -1):
                counts = {x: n for x, n in trie.get(s[i - k : i], {}).items() if x not in shut}
                t, d = sum(counts.values()), len(counts)
                if not t:
                    continue
                if s[i] in counts:
                    p *= counts[s[i]] / (t + d)
                    break
                p *= d / (t + d)
                shut |= set(counts)
            else:
                p /= 256 - len(shut)
            out += math.log10(p)
        return out

    return log10


def words_of(text):
    return [*bytes_of(text).translate(ASCII_LOWER).split(), None]


@pytest.mark.parametrize(("learn", "order"), [(True, 2), (True, 4), (True, 6), (False, 4)])
def test_against_plain_trie(spark, learn, order, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 400)
    monkeypatch.setattr(P, "BUCKET_BYTES", 1000)
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["the", "The", "cat", "é", "zq", "a\tb", "x" * rnd.randint(1, 9)]) for _ in range(rnd.randint(0, 40))), i % 3 == 1) for i in range(80)]
    rows += [(100, None, False), (99, None, True), (98, "", False), (101, "", True), (102, "unseen ÿ words!", True), (None, "the cat", False), (5, *rows[5][1:]), (103, "long " * 3000, True)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, held_out boolean, score double").repartition(3)
    train = [t for _, t, h in rows if not h] if learn else []
    got = P.score(docs, P.train(docs.where("not held_out") if learn else docs.limit(0), order=order)).collect()
    model, c = plain_model(train, order), Counter(w for t in train for w in words_of(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(words_of(t)), sum(c[w] > 0 for w in words_of(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words_of(t)), model(t)) for i, t, h in rows), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-6)


def test_probabilities_sum_to_one():
    data = np.frombuffer(b"abcaabcab", np.uint8)
    path, n = np.unique(P.paths_of(np.array([0, 4, 9]), data, 3)[0], return_counts=True)
    one = np.zeros((256, 256), np.int64)
    np.add.at(one, ((path >> np.uint64(8) & np.uint64(255)).astype(int), (path & np.uint64(255)).astype(int)), n)
    for context in (b"abc", b"\xff\xff\xff", b"zzz", b"xab", b"zza"):
        every = int.from_bytes(context, "big") * 256 + np.arange(256).astype(np.uint64)
        key, count = P.merged([path, every.astype(np.uint64)], [n, np.zeros(256, np.int64)])
        p = 10.0 ** P.log_probabilities(key, count, 3, one)[np.searchsorted(key, every)]
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        x = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        assert np.array_equal(P.grow(P.shrink(x)), x)


def test_model_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = lambda d: sum(len(P.grow(r.keys)) for r in P.train(d).paths.collect())
    assert size(docs.where("doc_id % 4 = 0")) < 0.75 * size(docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert P.score(docs, P.train(docs)).count() == 0


def test_held_out_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "octet_length(text) AS size")
    got = queries.op4_partial_matching(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").selectExpr("-sum(score) / log10(2D) / sum(size)").first()
    assert 0.8 < got[0] < 2.6, got

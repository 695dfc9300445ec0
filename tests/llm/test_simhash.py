import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import simhash as S
from trackloom.llm.components import connected_components


def brute_fingerprint(text, words=3):
    found = (text or "").encode().translate(S.ASCII_LOWER).split()
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else [b" ".join(found)][: len(found)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius):
    label = list(range(len(points)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(points))]


def near_points(rnd, n):
    base = [rnd.getrandbits(64) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        x = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def test_shard_and_tree_find_all_links():
    for seed, n in ((1, 700), (2, 1500), (3, 40)):
        points = near_points(random.Random(seed), n)
        x = np.array(points, np.uint64)
        want = brute_components(points, 2)
        assert S.shard_components(x, 2).tolist() == want
        vantage, mu = S.fit_tree(x[::3], 7, 2)
        which, node = S.route(x, vantage, mu, 7, 2)
        label = np.arange(n)
        for k in np.unique(node):
            own = np.unique(which[node == k])
            S.merge(label, own, own[S.shard_components(x[own], 2)])
        assert label.tolist() == want


def test_points_that_no_vantage_parts():
    x = np.array([1 << i for i in range(64)] + [0, (1 << 40) - 1], np.uint64)
    assert len(set(S.shard_components(np.repeat(x, 3), 2).tolist())) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBc \t\né"), max_size=30), min_size=1, max_size=8))
def test_fingerprints(texts):
    hashes = [S.shingle_hashes(t.encode(), 3) for t in texts]
    counts = np.array([len(h) for h in hashes])
    got = S.majority_bits(np.array([x for h in hashes for x in h], np.uint64), counts)
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_long_text_bits():
    text = " ".join(f"w{i % 97}" for i in range(2000))
    h = S.shingle_hashes(text.encode(), 3)
    assert S.majority_bits(np.array(h, np.uint64), np.array([len(h)]))[0] == brute_fingerprint(text)


def test_components_on_spark(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 40)
    rnd = random.Random(5)
    points = near_points(rnd, 600)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)]
    rnd.shuffle(rows)
    rows += [(1000 + i, rows[i][1]) for i in range(50)] + [(None, rows[0][1])]
    got = S.components(spark.createDataFrame(rows, "id long, fp long").repartition(3)).collect()
    label = brute_components([p % (1 << 64) for _, p in rows], 2)
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    assert sorted(((r.id, r.fp, r.component_id) for r in got), key=str) == sorted(((i, p, least[k]) for (i, p), k in zip(rows, label, strict=True)), key=str)


def test_near_duplicates(spark):
    rows = [(3, None), (1, ""), (2, "  "), (5, "One two"), (4, "one TWO"), (9, "a b c d"), (9, "a b c d"), (7, "x " * 3000)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    want = {(i, f"{brute_fingerprint(t):016x}") for i, t in rows}
    assert {x[:2] for x in got} == want and {x[0]: x[2] for x in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 7: 7}
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 3), (7, None)] + [(900, 900 + i) for i in range(1, 300)]
    random.Random(3).shuffle(chain)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500} | {900 + i: 900 for i in range(1, 300)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0

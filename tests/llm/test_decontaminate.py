import random
import re
from itertools import combinations

import numpy as np
import pytest

from trackloom.llm import decontaminate as D


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items):
    held = {}
    for i, x in items:
        v = words_of(x)
        size = min(12, len(v))
        for b in range(len(v) - size + 1 if i is not None and size >= D.LEAST else 0):
            held.setdefault(tuple(v[b : b + size]), set()).add(i)
    found = {}
    for d, t in docs:
        w = words_of(t)
        for v, own in held.items():
            for a in range(len(w) - len(v) + 1):
                equal = sum(p == q for p, q in zip(w[a : a + len(v)], v, strict=True))
                if len(v) - equal <= (2 if len(v) == 12 else len(v) >= 8):
                    found.setdefault(d, {}).setdefault((a, len(v)), []).append((equal, own))
    links = lambda f: [x for y in f.values() for x in y]
    return {(d, min(min(o) for _, o in links(f)), len(f), sum(len(o) for _, o in links(f)), min(a for a, _ in f), max(a + s - 1 for a, s in f), max(e for e, _ in links(f))) for d, f in found.items()}


@pytest.mark.parametrize("size", range(5, 13))
def test_masks_cover_all_substitutions(size):
    kept = [set(m.tolist()) for m in D.masks(size)]
    for gone in combinations(range(size), D.misses(size)):
        assert any(not set(gone) & k for k in kept)
    assert all(len(k) >= 4 for k in kept)


def cases():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 4, 5, 8, 11, 12, 20, 40])))) for i in range(25)]
    items += [(25, None), (26, ""), (None, "w1 w2 w3 w4 w5 w6"), *((i, items[0][1]) for i in range(27, 30)), (30, items[-1][1] + " " + items[-2][1])]
    docs = []
    for d in range(120):
        body = rnd.choices(vocabulary, k=rnd.randint(0, 60))
        if d % 2:
            part = rnd.choice([x for _, x in items if x]).split()
            for _ in range(rnd.randint(0, 4)):
                part[rnd.randrange(len(part))] = "changed"
            at = rnd.randint(0, len(body))
            body[at:at] = part
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(body).upper() if d % 3 else " ".join(body)))
    docs += [(200, None), (201, "..."), (202, "w5 " * 20000 + items[3][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 20 and any(x[3] > x[2] for x in want)
    a = spark.createDataFrame([(*r, 0, True) for r in docs], "doc_id long, text string, item_id int, contaminated boolean").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = D.overlaps(a, b)
    assert got.columns == list(D.RESULTS)
    got = [tuple(r) for r in got.collect()]
    assert set(got) == want and len(got) == len(want)
    out = D.flag(a, b)
    assert sorted(out.columns) == sorted(a.columns) and out.count() == len(docs)
    assert {r.doc_id for r in out.where("contaminated").collect()} == {x[0] for x in want}
    assert D.overlaps(a.limit(0), b).count() == 0 and D.overlaps(a, b.limit(0)).count() == 0
    assert D.flag(a, b.limit(0)).where("contaminated").count() == 0 and D.flag(a.limit(0), b).count() == 0


def test_repeated_rows_and_null_ids(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(None, item), (None, "clean"), (None, None), (1, item), (1, item), (1, "clean"), (2, "the"), (3, "w0 " + item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "the")], "item_id long, text string")
    assert sorted(((r.doc_id, r.n_windows) for r in D.overlaps(docs, bench).collect()), key=str) == [(1, 1), (3, 1), (None, 1)]
    got = D.flag(docs, bench).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got if r.contaminated) == sorted(str(r) for r in rows if r[1] and item in r[1]) and len(got) == len(rows)


def test_filter_has_all_seeds_and_reads_documents_once(spark):
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(40))) for i in range(500)], "item_id long, text string")
    seeds = D.benchmark_seeds(D.benchmark_windows(bench, "item_id", "text"))
    lanes, bits = D.seed_filter(seeds)
    own = np.array([r.seed for r in seeds.collect()]).view(np.uint64)
    assert len(own) == 500 * 29 * 6 and bits == 23 and len(D.passes(own, lanes, bits)) == len(own)
    other = np.random.default_rng(1).integers(0, 1 << 64, 100_000, dtype=np.uint64)
    assert len(D.passes(other, lanes, bits)) < 300
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = D.overlaps(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 3 and plan.count("Relation [") == 1


def test_window_hash_ignores_masked_words():
    x = np.arange(1, 13).astype(np.uint64)
    y = x.copy()
    y[[0, 1]] = 99
    assert any((D.seed(x, m, 12, 1) == D.seed(y, m, 12, 1)).all() for m in D.masks(12))


def test_many_items_share_a_prompt(spark):
    """3000 items and 3000 documents with the same first nine words and three of their own: lists are joined, not pairs."""
    prompt = " ".join(f"p{i}" for i in range(9))
    bench = spark.createDataFrame([(i, f"{prompt} b{i} c{i} d{i}") for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prompt} x{i} y{i} z{i}") for i in range(3000)] + [(9000, f"{prompt} b7 c7 z"), (9001, f"{prompt} b8 other d8")], "doc_id long, text string").repartition(2)
    windows = D.benchmark_windows(bench, "item_id", "text")
    seeds = D.benchmark_seeds(windows)
    found = D.document_seeds(docs.selectExpr("CAST(doc_id AS string) AS key", "text"), [12], *D.seed_filter(seeds))
    assert 0 < D.candidates(found, seeds).count() < 3000
    assert sorted((r.doc_id, r.item_id, r.n_links, r.equal_words) for r in D.overlaps(docs, bench).collect()) == [(9000, 7, 1, 11), (9001, 8, 1, 11)]


def test_short_items_count_where_asked(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "cat sat"), (6, "")], "item_id long, text string")
    assert D.overlaps(docs, bench).count() == 0
    assert [(r.doc_id, r.item_id) for r in D.overlaps(docs, bench, least=1).collect()] == [(1, 5)]

import random
import re
from collections import Counter

import numpy as np

from trackloom.llm import phrases as P


def words_in(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [[w for w in re.split("[ \t]", piece) if w] for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def counted(rows, length=4):
    f = Counter()
    for lang, text in rows:
        for w in words_in(text):
            f[lang or "und", ""] += len(w)
            f.update((lang or "und", " ".join(w[i : i + n])) for n in range(1, length + 1) for i in range(len(w) - n + 1))
    return f


def brute(rows, least, top=2000, share=80):
    f, out = counted(rows), []
    frequent = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    for (lang, phrase), a in frequent.items():
        w = phrase.split(" ")
        score, _, k = min((2000000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k, k) for k in range(1, len(w)))
        if not any(x == lang and len(y.split(" ")) > len(w) and f" {phrase} " in f" {y} " and 100 * b >= share * a for (x, y), b in frequent.items()):
            out.append((lang, -score, -a, phrase.encode(), phrase, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    ranked, seen = [], Counter()
    for lang, score, a, _, phrase, l, r in sorted(out):  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, -a, l, r, f[lang, ""], -score))
    return ranked


def corpus(seed, n=200):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "A", "new york", "new york city hall", "x.y", "a\tb", "\x1c", " ", "\xa0z"]
    return [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) + rnd.choice(["", ".", "!? ", "\r\n", "  "])) for _ in range(n)]


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_equals_counting(spark):
    rows = corpus(3) + [("en", None), (None, ""), ("fr", " . \t"), ("en", "one")]
    rows += [("en", "very common line here")] * 400
    data = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    for least, top, bits in ((5, 2000, None), (12, 7, None), (5, 2000, 8)):
        assert found(P.collocations(P.counts_of(data, least=least, bits=bits), top=top)) == brute(rows, least, top), (least, top, bits)
    assert P.collocations(P.counts_of(data.limit(0))).count() == 0


def test_counts_are_exact_whatever_the_sketch(spark, monkeypatch):
    """In one cell of a crowded sketch or in many, packed at once or often, texts whole or cut at pieces."""
    rows = corpus(4)
    want = {k: a for k, a in counted(rows).items() if a >= 6 or not k[1]}
    data = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for held, text, bits in ((P.HELD, P.TEXT, 4), (50, 100, 16)):
        monkeypatch.setattr(P, "HELD", held)
        monkeypatch.setattr(P, "TEXT", text)
        got = {(r.lang, r.phrase): r.f for r in P.counts_of(data, least=6, bits=bits).collect()}
        assert {k: a for k, a in got.items() if k[1]} == {k: a for k, a in want.items() if k[1]}
        assert {k: a for k, a in got.items() if not k[1] and a} == {k: a for k, a in want.items() if not k[1] and a}


def test_sketch_never_underestimates(spark):
    rows = [("en", " ".join(f"a{i % 50} b{i % 7}" for i in range(j, j + 90))) for j in range(40)]
    data = spark.createDataFrame(rows, "lang string, text string")
    bits = 14
    hot = P.hot_cells(data, bits, 30, 4)
    words = P.parsed([(t.encode().translate(P.PARTED), 0) for _, t in rows], ["en"])
    h, f, missed = None, counted(rows), 0
    for n in range(1, 5):
        h, whole = words.grams(n, h)
        for row in range(P.ROWS):
            cells = P.cells_of(h, row, bits)
            on = hot[row * 4 + n - 1][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & 1
            missed += sum(whole[i] and not on[i] and f["en", " ".join(w.decode() for w in words.words[i : i + n])] >= 30 for i in range(len(h)))
    assert missed == 0 and hot.any()
    assert np.unpackbits(hot).mean() < 0.05


def test_phrases_with_a_rare_part_are_in_no_sketch(spark):
    """A task sends no cells for them: before, pairs and longer phrases of all words were sent, and met in cells that became hot."""
    data = spark.createDataFrame([("en", " ".join(f"r{i} c" for i in range(j, j + 50))) for j in range(0, 500, 50)], "lang string, text string").repartition(3)
    hot = np.unpackbits(P.hot_cells(data, 8, 10, 4), axis=1).sum(axis=1).reshape(P.ROWS, 4)
    assert hot[:, 0].tolist() == [1] * P.ROWS and not hot[:, 1:].any()


def test_phrases_are_sent_packed_and_summed(spark, monkeypatch):
    """In many shards, packed after few phrases and summed often, counts are the same."""
    for name, value in (("PHRASES", 20), ("SHARD_TEXT", 500), ("TEXT", 100)):
        monkeypatch.setattr(P, name, value)
    rows = corpus(5)
    data = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(P.collocations(P.counts_of(data, least=6))) == brute(rows, 6)


def test_products_beyond_64_bits(spark):
    big = 9 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "", 0, big)], "lang string, phrase string, n_words int, f long")
    assert found(P.collocations(counts)) == [("en", 1, "a b", big - 1, big, big, big, 2000000 * (big - 1) // (2 * big))]


def test_packing():
    numbers = np.array([0, 1, 255, 256, 2**32 - 1, 7], np.uint32)
    assert P.unpacked(P.packed(numbers)).tolist() == numbers.tolist()

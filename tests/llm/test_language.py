import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import language as L
from trackloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_counts_against_brute_force():
    texts = [b"", b"a", "Déjà Vu, 9".encode(), b"ab" * 20, b"xyz"]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = L.ngram_counts(at, data, np.arange(5), 5)
    for i, t in enumerate(texts):
        alone = L.ngram_counts(np.array([0, len(t)]), np.frombuffer(t, np.uint8), np.array([0]), 1)[0]
        assert (alone == together[i]).all() and alone.sum() == max(0, len(t) - 1) + max(0, len(t) - 2)


def plain_ngrams(text):
    """The bins of a text's pairs and triples of bytes, one by one."""
    c = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text]
    for n in (2, 3):
        for i in range(len(c) - n + 1):
            h = c[i] * 0x9E3779B1 % 2**32
            for k in range(1, n):
                h = ((h ^ h >> 15) * 0x85EBCA77 + c[i + k] * 0xC2B2AE3D) % 2**32
            yield (h ^ h >> 13) % (L.BINS // 2) + (L.BINS // 2) * (n - 2)


def plain_predictions(learn, ask):
    """Codewords decoded text by text with dicts and loops: (language, probability) of each text, und without letters."""
    counts = {}
    for text, lang in learn:
        own = counts.setdefault(lang, [0] * L.BINS)
        for b in plain_ngrams(text):
            own[b] += 1
    langs = sorted(counts)
    shares = {x: [(v + L.SMOOTH) / (sum(counts[x]) + L.SMOOTH * L.BINS) for v in counts[x]] for x in langs}
    bits = []
    for mask in range(1, 2 ** (len(langs) - 1)):  # all ways to part the languages, the first always on one side
        side = {x: 1 if i and mask >> (i - 1) & 1 else -1 for i, x in enumerate(langs)}
        mean = lambda s, b: sum(shares[x][b] for x in langs if side[x] == s) / sum(side[x] == s for x in langs)
        weight = [math.log(mean(1, b) / mean(-1, b)) for b in range(L.BINS)]
        trust = max(0.0, min(side[x] * sum(p * w for p, w in zip(shares[x], weight, strict=True)) for x in langs))
        bits.append((side, weight, trust))
    usual = sum(t for *_, t in bits) / len(bits)
    for text in ask:
        if not any(map(str.isalpha, text.decode())):
            yield "und", 0.0
            continue
        grams = list(plain_ngrams(text))
        loss = dict.fromkeys(langs, 0.0)
        for side, weight, trust in bits:
            margin = sum(weight[b] for b in grams) / max(1, len(grams)) * L.SHARPNESS * math.sqrt(min(len(grams), L.FIRM) / L.FIRM)
            for x in langs:
                loss[x] += math.log1p(math.exp(-margin * side[x])) * trust / usual
        best = min(langs, key=lambda x: loss[x])
        yield best, 1 / sum(math.exp(loss[best] - v) for v in loss.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_a_plain_predictor(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    top = max(r[0] for r in rows)
    rows += [(top + 1, None, "en"), (top + 2, "", "de"), (top + 3, "4 + 5", None), (top + 4, "Ärger über Öl", None), (top + 5, "Das ist ein Haus. " * 70000, None)]  # the last is longer than a piece
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_language_codes(spark, str(tmp_path)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learn = [(t.encode(), x) for i, t, x in rows if t is not None and x is not None and not held(i)]
    assert 2 < len({x for _, x in learn}) <= 5 and len(got) == len(rows)
    for (i, t, _), (lang, score) in zip(rows, plain_predictions(learn, [(t or "").encode() for _, t, _ in rows]), strict=True):
        assert got[i].held_out == held(i) and got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9), i


def test_ties_go_to_the_first_name():
    same = np.arange(L.BINS, dtype=float)
    m = L.model_of({"b": same, "a": same, "c": same})
    first, _, flag = m.predict(np.ones((1, L.BINS), np.int64))
    assert m.languages[first[0]] == "a" and flag[0]


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_differ(n):
    code = L.code_matrix(n)
    assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(0)) < n).all()


def test_many_languages():
    rng = np.random.default_rng(0)
    counts = {f"l{i:02}": rng.gamma(0.1, 100, L.BINS) for i in range(30)}
    m = L.model_of(counts)
    rows = np.array([rng.multinomial(400, counts[x] / counts[x].sum()) for x in m.languages])
    assert m.predict(rows)[0].tolist() == list(range(30))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    got = queries.op5_language_codes(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right, sure = got.where("held_out and lang is not null").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg((~F.col("ambiguous")).cast("int"))).first()
    assert n > 100 and right > 0.97 and sure > 0.97


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "u"), (2, "le chat et le chien", "fr", "u"), (3, None, "en", "u"), (4, "", None, "u"), (5, "12 -- 3", "fr", "u"), (6, "der Hund", None, "u"), (7, "ñ", None, "u"), (None, "the dog " * 20000, None, "u"), (1, "the cat and the dog", "en", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = L.identify(docs, L.fit(docs)).collect()
    assert len(got) == 9 and [r.lang_pred for r in got if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id == 1} == {"en"} and [r.lang_pred for r in got if r.doc_id == 2] == ["fr"]
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"] and all(0 <= r.lang_score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id == 7][0] in ("en", "fr")
    one = L.identify(docs, L.fit(docs.where("lang = 'fr'"))).collect()
    assert {r.lang_pred for r in one} == {"fr", "und"}
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs.limit(0))).collect()} == {"und"}
    assert L.identify(docs.limit(0), L.fit(docs)).count() == 0

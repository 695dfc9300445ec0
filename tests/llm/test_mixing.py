import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing as M

TARGETS = {"source": {"a": 0.5, "b": 0.3, "other": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"t": 0.7, "u": 0.3, "gone": 0.5}}


def docs_of(spark):
    rows = []
    for i in range(4000):
        rows.append((i, "a" if i % 3 == 0 else "b" if i % 3 == 1 else None if i % 5 == 0 else "zz", "x" if i % 7 < 5 else "y", "t" if i % 2 else "u", 10 + i % 11, 5))
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long, kept int").drop("kept")


def test_margins_meet_targets(spark):
    docs = docs_of(spark)
    cells = M.calibrated(docs, TARGETS).collect()
    for m, goal in (("source", {"a": 0.5, "b": 0.3, "other": 0.2}), ("lang", {"x": 0.6, "y": 0.4}), ("topic", {"t": 0.7, "u": 0.3})):
        for value, share in goal.items():
            assert sum(c.weight for c in cells if c[f"g_{m}"] == value) == pytest.approx(share, abs=1e-9)
    assert max(c.probability for c in cells) == 1
    out = M.mix(docs, TARGETS).where("kept")
    total = out.agg(F.sum("tokens")).first()[0]
    for m, value, share in (("source", "a", 0.5), ("lang", "x", 0.6), ("topic", "t", 0.7)):
        assert out.where(F.col(f"g_{m}") == value).agg(F.sum("tokens")).first()[0] / total == pytest.approx(share, abs=0.05)


def test_against_plain_loops(spark):
    cells = {(c.g_source, c.g_lang, c.g_topic): c for c in M.calibrated(docs_of(spark), TARGETS).collect()}
    w = {k: float(c.tokens) for k, c in cells.items()}
    for _ in range(20):
        for i, m in enumerate(M.MARGINS):
            sums = {}
            for k, v in w.items():
                sums[k[i]] = sums.get(k[i], 0) + v
            w = {k: v * TARGETS[m].get(k[i], 0) / sums[k[i]] if sums[k[i]] else 0 for k, v in w.items()}
    top = max(w[k] / c.tokens for k, c in cells.items())
    for k, c in cells.items():
        assert c.probability == pytest.approx(w[k] / c.tokens / top, abs=1e-8)


def test_scarce_values_meet_their_targets(spark):
    """A language with one token in a thousand gets a tenth of the mix; margins() says so."""
    rows = [(i, "ab"[i % 2], "x" if i % 1000 else "y", "tu"[i // 2 % 2], 20) for i in range(40000)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}, "topic": {"t": 0.6, "u": 0.4}}
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    got = {(r.margin, r.value): r for r in M.margins(M.mix(docs, targets), targets).collect()}
    assert len(got) == 6 and all(r.expected == pytest.approx(r.wanted, abs=1e-6) for r in got.values())
    assert got["lang", "y"].kept == pytest.approx(0.1, abs=0.04)


def test_topic_and_tokens(spark):
    texts = {None: ("empty", 0), "": ("empty", 0), "  ": ("empty", 0), "a | b": ("table", 3), "a|b c": ("short", 2), "x\u00a0y\n z": ("short", 2), "w " * 750: ("long", 750), "w " * 749 + "w": ("short", 750)}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (r.form, r.n) for r in docs.select("text", M.form_of(F.col("text")).alias("form"), M.tokens_of(F.col("text")).alias("n")).collect()}
    assert got == texts


def test_edges(spark):
    rows = [(1, "a", "x", "t", 5), (1, "a", "x", "t", 5), (None, None, None, None, 0), (2, "b", "q", "u", 0), (3, "b", "x", "t", None)]
    docs = spark.createDataFrame([(*r, 1.0, 2.0, "k", 7) for r in rows], "doc_id long, source string, lang string, topic string, tokens long, g_source double, probability double, kept string, weight int")
    out = M.mix(docs, TARGETS)
    got = out.collect()
    assert sorted(out.columns) == sorted(docs.columns + ["g_lang", "g_topic"]) and {r.weight for r in got} == {7}
    assert len(got) == 5 and [r.kept for r in got if r.doc_id == 1] == [True, True] and all(r.kept for r in got if not r.tokens)
    assert M.mix(docs.limit(0), TARGETS).count() == 0

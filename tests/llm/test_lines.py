import hashlib
import random

from trackloom.llm import lines as L
from trackloom.llm.common import shared_dir


def brute(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, kept) of rows (doc_id, text) by plain counting."""
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        stay = [x for x in all_lines if len(held.get(key(x), [])) < min_docs or max(held[key(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    common = [f"  This line number {i} is in many documents, É{i} " + "x" * (i % 7) for i in range(30)]
    rows = []
    for doc in range(n):
        own = [rnd.choice([rnd.choice(common), rnd.choice(common).upper(), f"own {doc} {rnd.random()}" * 2, "", "short"]) for _ in range(rnd.randint(0, 12))]
        rows.append((doc * 7 % 1000, "\n".join(own) + rnd.choice(["", "\n", "\r\n", "\t"])))
    return rows


def test_equals_counting(spark):
    rows = corpus(1)
    rows += [(None, rows[3][1]), (None, None), (5000, None), (5001, ""), (5002, "\n\n"), rows[5], rows[5], (5003, "\n".join([rows[0][1]] * 3))]
    for batches, fanout in ((1, 2), (7, 2), (6, 3)):
        data = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        for few in (0, 1000):  # joined and broadcast
            assert found(L.dedup(data, batches=batches, fanout=fanout, few=few)) == brute(rows), (batches, fanout, few)


def test_borders(spark):
    """39 and 40 code points (not bytes), 4 and 5 documents, a line twice in its last document, blanks at ends, upper case outside ASCII."""
    a, b = "é" * 40, "é" * 39
    rows = [(i, f"{a}\n{b}\nown {i}") for i in range(5)] + [(i, "F" * 50 + f"\nx{i}") for i in range(10, 14)] + [(20, f"\t{a} \r\n{a}"), (21, "É" * 40)]
    got = found(L.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert [r[2] for r in sorted(got)] == [1] * 5 + [0] * 6


def test_other_columns_and_no_rows(spark):
    rows = [(i, "z" * 60, "mine", 3, [i]) for i in range(6)]
    data = spark.createDataFrame(rows, "doc_id long, text string, batch string, last int, h1 array<int>")
    out = L.dedup(data.withColumn("kept", data.doc_id))
    assert out.columns == ["doc_id", "text", "batch", "last", "h1", "n_lines", "n_dropped", "kept"]
    assert sorted((r.doc_id, r.batch, r.last, r.h1, r.kept) for r in out.collect()) == [(i, "mine", 3, [i], "z" * 60 if i == 5 else "") for i in range(6)]
    assert L.dedup(data.limit(0)).count() == 0


def test_long_text_with_many_lines(spark):
    text = "\n".join(f"line {i % 5000} of a very long text, long enough to count" for i in range(60000))
    rows = [(i, text) for i in range(5)]
    for doc, n_lines, n_dropped, kept in found(L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=3)):
        assert n_lines == 60000 and n_dropped == (0 if doc == 4 else 60000)
        assert hashlib.sha256(kept.encode()).hexdigest() == hashlib.sha256(text.encode() if doc == 4 else b"").hexdigest()


def test_runs_are_few_and_hold_a_line_once(spark):
    """After each batch a level has fewer runs than FANOUT, a line is fresh in one run, and removed runs leave nothing."""
    shared_dir(spark)
    runs = L.Runs(spark, fanout=2)
    for batch in range(7):
        lines = spark.createDataFrame([(100 - batch, h, h) for h in range(batch * 10, batch * 10 + 30)], "doc_id long, h1 long, h2 long")
        runs.add(lines)
        assert all(len(level) < 2 for level in runs.levels)
    rows = [r for n in runs.names() for r in spark.table(n).collect()]
    fresh = [r.h1 for r in rows if r.fresh]
    assert len(fresh) == len(set(fresh)) == 90 and sum(r.n_docs for r in rows) == 210
    assert {r.h1: r.last for r in runs.frequent(3).collect()} == {h: 100 - (h - 20) // 10 for h in range(20, 70)}
    names = runs.names()
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name in names]


def test_known_runs_are_not_shuffled(spark):
    """Only a batch's own lines cross an exchange; runs are met where they lie."""
    shared_dir(spark)
    runs = L.Runs(spark, fanout=4)
    rows = spark.range(1000).repartition(3).selectExpr("id AS doc_id", "xxhash64(id) AS h1", "id AS h2")
    runs.add(rows)
    runs.add(rows)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = runs.marked(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2
    assert runs.marked(rows).where("fresh").count() == 0
    runs.close()

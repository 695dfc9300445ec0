import random

import numpy as np
import pytest

import corpus_pipeline as P
from trackloom.llm import near_copies as N
from trackloom.llm import language, simhash, token_records
from trackloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


def jaccard(a, b, words=5):
    x, y = (set(simhash.shingle_hashes((t or "").encode(), words)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def family(rnd, n_families=12):
    rows = []
    for f in range(n_families):
        base = [f"t{rnd.randrange(4000)}" for _ in range(rnd.randint(60, 400))]
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 30)):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 60)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
            rows.append(" ".join(copy))
    return rows + [" ".join(f"u{rnd.randrange(4000)}" for _ in range(rnd.randint(1, 200))) for _ in range(100)]


def groups_of(texts, similar=0.8):
    """id: least id of its group, of all texts in groups, by comparing all pairs."""
    own = {i: set(simhash.shingle_hashes((t or "").encode(), 5)) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and root[i] != root[j] and own[i] and len(own[i] & own[j]) >= similar * len(own[i] | own[j]) - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i: r for i, r in root.items() if i != r}


def test_near_copies_against_all_pairs(spark):
    rnd = random.Random(11)
    texts = family(rnd)
    rnd.shuffle(texts)
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5000, None, 0), (5001, "", 0), (5002, " \n", 0), (None, texts[0], 0), (3, texts[3], 0), (5003, texts[3].upper(), 0)]
    got = {r.doc_id: r.group_id for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string, group_id int")).collect()}
    want = groups_of({i: t for i, t, _ in rows if i is not None})
    assert got == want and len(want) > 60
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of 30 to 3,000 words just above and just below 0.8, edited in place."""
    rnd = random.Random(21)
    texts = {}
    for f in range(200):
        n = int(30 * 100 ** rnd.random())
        base = [f"t{rnd.randrange(20000)}" for _ in range(n)]
        copy = list(base)
        while True:
            at = rnd.randrange(n)
            trial = copy[:at] + [f"n{rnd.randrange(10**6)}"] + copy[at + 1 :]
            if jaccard(" ".join(base), " ".join(trial)) < 0.8:
                break
            copy = trial
        texts[2 * f], texts[2 * f + 1] = " ".join(base), " ".join(copy if f % 4 else trial)
    got = {r.doc_id: r.group_id for r in N.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = groups_of(texts)
    assert len(want) == 150 and got.items() <= want.items() and len(got) >= 0.97 * len(want), len(got)
    print(f"recall {len(got) / len(want):.3f}")


def test_no_pairs_of_a_large_family(spark, monkeypatch):
    """Copies of one text with words of their own, each too far from all others: nothing is linked, and few pairs are compared."""
    rnd = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(600):
        copy = list(base)
        for k in rnd.sample(range(120), 6):
            copy[k] = f"n{i}x{k}"
        rows.append((i, " ".join(copy)))
    compared = []
    monkeypatch.setattr(N, "verified", lambda pairs, *a, f=N.verified: compared.append(pairs.count()) or f(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in N.near_copies(docs).collect()}
    assert got == groups_of(dict(rows)) and sum(compared) < 40 * len(rows), compared


def test_few_rows_are_stored_in_few_files(spark, monkeypatch):
    """Each of the shuffle's partitions became a file, however few its rows, and for each file an executor started a process."""
    from trackloom.llm import components

    texts, parts = family(random.Random(11)), []
    for m in (N, components):
        monkeypatch.setattr(m, "cut", lambda df, *a, f=m.cut: (out := f(df, *a), parts.append(out.rdd.getNumPartitions()))[0])
    off = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.group_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == groups_of(dict(enumerate(texts)))
    few = spark.sparkContext.defaultParallelism
    assert sum(n <= few for n in parts) > 0.75 * len(parts), parts


def test_similarity_of_sketches():
    sketch = lambda x: np.sort(np.array(x, "<u4")).tobytes()
    assert N.similarity([sketch([1, 2, 4]), b"", sketch([7])], [sketch([1, 3, 4]), b"", b""]).tolist() == pytest.approx([2 / 4, 0, 0])
    rng = np.random.default_rng(3)
    whole = rng.choice(1 << 32, 6000, replace=False)
    least = lambda x: np.sort(x)[: N.SKETCH].astype("<u4").tobytes()
    got = N.similarity([least(whole[:5400])] * 2, [least(whole[600:]), least(whole[:5400])])
    assert got[0] == pytest.approx(0.8, abs=0.1) and got[1] == 1


@pytest.mark.parametrize("size", [20, 200, 700, 2500, 9000])
def test_near_copies_of_any_length(spark, size):
    rnd = random.Random(size)
    rows, pairs = [], []
    for f in range(24):
        base = [f"t{rnd.randrange(20000)}" for _ in range(int(size * rnd.uniform(0.8, 1.25)))]
        copy = list(base)
        if f % 3 == 0:
            for _ in range(rnd.randint(1, max(1, len(base) // 80))):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
        elif f % 3 == 1:
            copy = copy[: int(len(copy) * rnd.uniform(0.85, 0.98))]
        else:
            copy += [f"n{rnd.randrange(10**6)}" for _ in range(max(1, int(len(copy) * rnd.uniform(0.02, 0.15))))]
        texts = [" ".join(base), " ".join(copy)]
        rows += [(2 * f + i, t) for i, t in enumerate(texts)]
        pairs.append((jaccard(*texts), 2 * f))
    got = {r.doc_id: r.group_id for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure = [x for j, x in pairs if j >= 0.86]
    assert len(sure) >= 10 and [x for x in sure if got.get(x + 1) != x] == []
    assert all(j > 0.74 for j, x in pairs if x + 1 in got) and all(got[x] + 1 == x for x in got)


def test_near_copies_beyond_the_heads(spark):
    """Two copies whose every shared group is headed by a third, less similar text; and a chain of copies."""
    rnd = random.Random(5)
    new = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    classes = lambda words: {(h * 0x9E3779B97F4A7C15 % 2**64 >> 59) % N.CLASSES for h in simhash.shingle_hashes(" ".join(words).encode(), 5)}
    heads, texts = [], []
    for _ in range(8):
        base = new(44)
        free, head = set(range(N.CLASSES)) - classes(base), list(base)
        while len(head) < 56:
            word = new(1)
            if classes([*head[-4:], *word]) <= free:
                head += word
        heads += [head] * 2
        texts += [base + new(4), base + new(4)]
    chain = new(60)
    for _ in range(30):
        texts.append(chain)
        chain = [*chain[5:], *new(5)]
    rnd.shuffle(texts)
    texts = [" ".join(t) for t in heads + texts]
    own = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.group_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: r for i, r in enumerate(root) if i != r} and len(got) == 8 + 8 + 29


def test_near_copies_at_the_threshold(spark):
    """Pairs of long texts just above and just below the threshold fall on the right side."""
    rnd = random.Random(8)
    new = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    rows, want = [], {}
    for f in range(40):
        base = new(rnd.randint(600, 1500))
        n = len(base) - 4
        shared = int(n * (0.795, 0.805, 0.78, 0.82)[f % 4])  # the copy is a beginning of the text
        texts = [" ".join(base), " ".join(base[: shared + 4])]
        rows += [(2 * f + i, t) for i, t in enumerate(texts)]
        if jaccard(*texts) >= 0.8:
            want[2 * f + 1] = 2 * f
    got = {r.doc_id: r.group_id for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) == 20


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.collect()}
        assert kept <= clean.keys()
        if name == "language_id":
            letters = {d for d, t in clean.items() if t and any(map(str.isalpha, t))}
            found = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
            assert kept == {d for d in letters if not found[d].lang_ambiguous} and len(kept) >= 0.99 * len(letters)
            assert all(r.lang == found[r.doc_id].lang_pred for r in out.collect())
        if name == "near_dedup":
            gone = clean.keys() - kept
            assert gone == groups_of(clean).keys()
        if name == "decontamination":
            whole = {d for d, t in clean.items() if any(x in t for _, x in bench)}
            assert not whole & kept and len(kept) > 0.9 * len(clean)
        if name == "mixing":
            assert 0.1 * len(clean) < len(kept) < len(clean)


CLASHING = "doc_id long, source string, lang string, text string, topic string, tokens string, kept string, probability string, g_lang string, g_source string, contaminated string, lang_pred string, lang_score string, lang_ambiguous string, Key string"


def edge_rows():
    """Rows of id, source, lang and text: repeated, without id, source, lang or text, empty, blank and long."""
    bench = "which of the following planets has the largest number of known moons in our solar system today"
    english, french = "the cat sat on the mat and looked at the dog near the old house ", "le chat est sur la table et regarde le chien dans la vieille maison "
    plain = [(10 + i, f"src{i % 3}", "en" if i % 2 else "fr", (english if i % 2 else french) + " ".join(f"{'w' if i % 2 else 'q'}{i}x{k}" for k in range(12))) for i in range(20)]
    copies = [(1, "src0", "en", english * 2), (2, "src1", None, english * 2), (2, "src1", None, english * 2), (None, None, None, english * 2), (None, None, None, english * 2)]
    bare = [(3, "src0", "en", None), (4, None, None, ""), (5, "src0", "fr", " \n\t"), (6, "src0", "en", "12 -- 3"), (None, None, None, None)]
    taken = [(7, "src0", "en", f"so {bench} please"), (None, "src0", "en", f"and {bench} again")]
    return plain + copies + bare + taken + [(8, "src0", "fr", french * 3000)], bench


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    rows, bench = edge_rows()
    folder = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(0, bench), (1, None), (2, ""), (None, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    own = CLASHING.split(", ")[4:]
    return spark.createDataFrame([r + tuple(f"own{i}" for i in range(len(own))) for r in rows], CLASHING), folder


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_edges_of_a_stage(spark, edges, name):
    docs, folder = edges
    stage = dict(P.STAGES)[name]
    assert stage(spark, docs.limit(0), folder).count() == 0
    rows = edge_rows()[0]
    out = stage(spark, docs, folder).collect()
    ids = sorted((r.doc_id for r in out if r.doc_id is not None))
    nameless = [r for r in out if r.doc_id is None]
    if name == "token_output":
        assert len(out) == len(rows) and ids == sorted(r[0] for r in rows if r[0] is not None)
        assert {r.n_tokens for r in out if r.doc_id in (3, 4)} == {1}
        return
    assert all(list(r)[4:] == [f"own{i}" for i in range(len(r) - 4)] for r in out)  # a caller's columns
    given = {(r[0], r[3]): r for r in rows}
    assert all(tuple(r)[:2] == given[r.doc_id, r.text][:2] for r in out)
    assert name == "language_id" or all(r.lang == given[r.doc_id, r.text][2] for r in out)
    every = sorted(r[0] for r in rows if r[0] is not None)
    if name == "language_id":
        assert ids == [i for i in every if i not in (3, 4, 5, 6)] and len(nameless) == 3
        assert all(r.lang == ("fr" if r.doc_id == 8 or "chat" in r.text else "en") for r in out)
    if name == "near_dedup":
        assert ids == [i for i in every if i != 2] and len(nameless) == 4
    if name == "decontamination":
        assert ids == [i for i in every if i != 7] and len(nameless) == 3
    if name == "mixing":
        assert {3, 4} <= set(ids) and ids.count(2) in (0, 2)


def test_folders_go(spark, tmp_path, monkeypatch):
    """Of a run only the last stage's table and the token files stay."""
    monkeypatch.setattr("trackloom.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    P.run(spark, "/root/testdata/sf0.001").count()
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["pipeline-token_output", "token-records"]


def test_whole_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encode = token_records.encoder(tokenizer_path()).tokenizer
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(encode.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1)
        start += r.n_tokens

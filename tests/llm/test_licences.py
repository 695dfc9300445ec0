import random
import re

from trackloom.llm import licences as L
from trackloom.llm.common import ASCII_LOWER


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(ASCII_LOWER).decode())


def brute(texts):
    """Result of each text, by trying each template at each place."""
    own = [words_of(t) for t in texts]
    df = {w: sum(w in words for words in map(set, own)) for t in L.BASE + L.TEMPLATES for w in t.text.split()}
    out = []
    for words in own:
        base, labels, best = [], set(), 0.0
        for t in L.BASE + L.TEMPLATES:
            p = t.text.split()
            keys = [i for m in t.mandatory for i in range(len(p)) if p[i : i + len(m.split())] == m.split() for i in range(i, i + len(m.split()))]
            rare = min(keys, key=lambda i: (df[p[i]], i))
            for start in range(-len(p), len(words)):
                equal = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(p)]
                if equal[rare]:
                    best = max(best, sum(equal) / len(p))
                if all(equal[i] for i in keys) and sum(equal) >= (1 if t.base else 0.75) * len(p):
                    labels.add(t.label)
                    base += [(start, t.label)] if t.base else []
        at = [i for i, _ in base]
        out.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(best, 9)))
    return out


def texts_of(rnd):
    pool = ["under", "the", "MIT", "License", "apache", "Apache", "version", "2", "cc", "BY", "nc", "-", "\n", "é", "ſ", "K", "x9", "license,", "(mit)"]
    texts = ["", None, "Under the MIT License", "cc-by-nc cc by nc CC BY NC", "mit license", "Apache License, Version 2.0 under the mit licenses"]
    texts += [" ".join(rnd.choices(pool, k=rnd.randint(0, 80))) for _ in range(100)]
    texts += ["pad " * rnd.randint(0, 9) + rnd.choice(["under the mit license", "cc/by/nc", "apache license version 2"]) + " pad" * rnd.randint(0, 9) for _ in range(40)]
    for t in L.TEMPLATES * 4:  # some words replaced, key phrases kept, broken or cut off
        p = t.text.split()
        free = [i for i in range(len(p)) if i not in L.key_positions(t)]
        for i in rnd.sample(free, min(len(free), rnd.randint(0, len(p) // 3))):
            p[i] = rnd.choice(["other", "the", "license"])
        if rnd.random() < 0.3:
            p[rnd.choice(L.key_positions(t))] = "broken"
        texts.append("x " * rnd.randint(0, 3) + " ".join(p[rnd.choice([0, 0, 0, 2]) :]).title() + " y" * rnd.randint(0, 3))
    return texts


def test_against_brute_force(spark):
    texts = texts_of(random.Random(4))
    texts += ["filler words " * 30000 + "Released under the MIT License."]
    rows = [(i, t, "extra", 7, 0.5, "own") for i, t in enumerate(texts)] + [(3, texts[3], "extra", 7, 0.5, "own"), (None, "cc by nc", "extra", 7, 0.5, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_base int, score double, labels string")
    got = L.scan(docs).collect()
    assert len(got) == len(rows) and {r.source for r in got} == {"extra"}
    key = lambda x: str(x)
    have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got), key=key)
    assert have == sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]), strict=True)), key=key)
    assert len({r.labels for r in got}) > 10


def test_replaced_rare_words(spark):
    """A template with three rare words replaced still holds: its key phrases do."""
    rare = {"apache-2": "may not you", "gpl": "free program software", "mpl-2": "code form source"}
    rows = []
    for t in L.TEMPLATES:
        if t.label in rare:
            rows.append((t.label, " ".join("zzz" if w in rare[t.label].split() and i not in L.key_positions(t) else w for i, w in enumerate(t.text.split()))))
    got = L.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert len(got) == 3 and all(r.labels == r.want and 0.75 <= r.score < 1 for r in got)


def test_templates(spark):
    bsd = "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met"
    gpl = "This work is licensed under the GNU General Public License, version 3."
    missing = gpl.replace("Public", "Private")
    docs = spark.createDataFrame([(1, bsd), (2, gpl), (3, missing), (4, "plain text")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(docs).collect()}
    assert got[1][0] == "bsd" and 0.9 < got[1][1] < 1 and got[2] == ("gpl-3", 1.0)
    assert got[3][0] == "" and got[3][1] < 1 and got[4] == ("", 0.0)
    assert L.scan(docs.limit(0)).count() == 0

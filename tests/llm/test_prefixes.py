import hashlib
import random
import zlib

from pyspark.sql import functions as F

from trackloom.llm import prefixes as P


def brute(rows, rebuilt=True):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, sha) by plain sequences."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    seqs = {}
    for c in own:
        own[c] = [(r, t) for _, _, r, t in sorted(own[c])]
    for c, turns in own.items():
        h, base = (zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)) if rebuilt else (0, c)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for s in nodes:
        if s:
            kids[s[:-1]] = kids.get(s[:-1], 0) + 1
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] = leaves.get(s[:d], 0) + (s not in kids)
            saved[s[:d]] = saved.get(s[:d], 0) + (len(members) - 1) * (len(s[-1][1].decode()) if s else 0)
    ends = lambda s: hashlib.sha256(",".join(str(c) for c in sorted(x for x in nodes[s] if seqs[x] == s)).encode()).hexdigest()
    return sorted((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), kids.get(s, 0), leaves[s], saved[s], ends(s)) for s, m in nodes.items())


def found(spark, rows, rebuilt=True):
    data = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(4)
    out = P.prefix_trie(data, P.shared_heads(F.col("conv")) if rebuilt else None).collect()
    at = sorted(out, key=lambda r: r.position)
    assert [r.position for r in at] == list(range(len(at)))
    stack = []
    for r in at:  # intervals nest, and what is open above a node are its ancestors
        while stack and stack[-1].end < r.position:
            stack.pop()
        assert len(stack) == r.depth and all(r.end <= s.end for s in stack) and (not stack or stack[-1].conv_id == r.parent_conv_id)
        stack.append(r)
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def dialogues(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        conv = rnd.choice([c, c * 13, -c])
        for turn in rnd.sample([None, *range(12)], rnd.randint(1, 9)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "b", "é" * 9, "", None])))
    return rows


def test_equals_sequences(spark):
    for seed in (1, 2):
        rows = dialogues(seed)
        assert found(spark, rows) == brute(rows)
        assert found(spark, rows, False) == brute(rows, False)


def test_edges(spark):
    """Equal turns and repeated rows, a null id, conversations of which nothing stays, no rows at all."""
    rows = [(7, 1, "user", "x")] * 5 + [(8, 1, "user", "x"), (8, 1, "user", "x"), (None, 1, "user", "x"), (305, None, None, None), (-205, 3, "a", "b" * 10000)]
    assert found(spark, rows) == brute(rows)
    gone = [(c, 0, "u", "x") for c in range(401, 460)]  # their base is not there: many are turnless
    assert found(spark, gone) == brute(gone)
    assert found(spark, []) == []


def test_caterpillar_copies_and_one_long_dialogue(spark):
    """Each a prefix of the next; thousands alike; one with a third of all turns, which another leaves late."""
    rows = [(c, t, "u", f"t{t}") for c in range(40) for t in range(c)]
    rows += [(1000 + c, t, "u", "same") for c in range(700) for t in range(2)]
    rows += [(5000 + c, t, "u", f"long {t}" if t != 270 or c else "other") for c in range(2) for t in range(300)]
    assert found(spark, rows, False) == brute(rows, False)
    assert found(spark, rows) == brute(rows)

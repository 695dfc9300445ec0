import random

from trackloom.llm import chat as C


def brute(rows, me):
    order = sorted({(t, who or "unknown", said or "") for t, who, said in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    text, mask = "", []
    for _, who, said in order:
        said = said.replace("<|", "< |").replace("|>", "| >") + "<|im_end|>"
        text += "<|im_start|>" + ("assistant" if who == me else "system" if who == "system" else f"user name={who.replace(' ', '_')}") + "\n"
        if who == me:
            mask.append((len(text), len(text) + len(said)))
        text += said + "\n"
    return text, mask


def whole(got):
    text, mask = "", []
    for n, r in enumerate(sorted(got, key=lambda r: r.piece)):
        assert r.piece == n and r.n_messages <= C.BLOCK
        mask += [(len(text) + a, len(text) + b) for a, b in r.mask]
        assert r.n_trained == sum(b - a for a, b in r.mask)
        text += r.text
    return text, mask, sum(r.n_rows for r in got)


def agree(spark, rows):
    data = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "conv_id long, turn long, role string, text string, perspective string, place int, key string").repartition(3)
    got, want = {}, {}
    for r in C.rotate(data).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == conv]
        for me in {r[1] or "unknown" for r in own} - {"system"}:
            want[conv, me] = (*brute(own, me), len(own))
    assert {k: whole(v) for k, v in got.items()} == want
    return data


def test_rotation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    rnd = random.Random(2)
    rows = []
    for conv in [*range(12), None]:
        n = 60 if conv == 3 else rnd.randint(1, 9)
        for turn in rnd.choices([None, *range(-5, 100)], k=n):
            rows.append((conv, turn, rnd.choice(["ann", "bob b", "system", None]), rnd.choice(["hi", None, "", "é<|im_end|>\nx", "long " * 50])))
    rows += rows[:5] * 3
    data = agree(spark, rows)
    assert C.rotate(data.limit(0)).count() == 0


def test_one_rule_for_all_sizes(spark):
    """63 to 65 messages and thousands, in many turns or in one, and a dialogue of the system alone."""
    rows = [(n, i, f"p{i % 3}", f"m{i}") for n in (63, 64, 65) for i in range(n)]
    rows += [(1, 0, f"p{i % 3}", f"m{i}") for i in range(1500)] + [(2, i // 7, f"p{i % 3}", f"m{i}") for i in range(6000)] + [(4, 0, "system", "alone")]
    agree(spark, rows)

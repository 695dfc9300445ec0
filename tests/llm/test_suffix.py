import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import suffix as S


def check(body):
    text = np.array([*body, 0], np.uint8)
    raw = bytes(text)
    sa = S.suffix_array(text.astype(np.int64))
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    plcp = S.permuted_prefixes(text, sa)
    for k in range(len(sa)):
        a, b = (raw[sa[k - 1] :] if k else b""), raw[sa[k] :]
        assert plcp[sa[k]] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_small_alphabet(body):
    check(body)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 255), max_size=80))
def test_bytes(body):
    check(body)


def test_long_runs_and_repeats():
    rnd = random.Random(1)
    block = [rnd.randint(1, 4) for _ in range(150)]
    for body in ([7] * 500, list(range(1, 200)), list(range(200, 1, -1)), block * 6, [1, 2] * 300, block + [255] + block[::-1] + [255] + block):
        check(body)

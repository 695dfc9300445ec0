import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import token_records as R
from trackloom.llm.queries import tokenizer_path

PATH = tokenizer_path()


def reference(texts):
    t = R.encoder(PATH).tokenizer
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé́Σ 's\t\n\x0b\x1c\x85  <|endoftext|>9½👍🏽\r"), max_size=40), min_size=1, max_size=4))
def test_words_equal_whole_texts(texts):
    ids, at = R.encoder(PATH).encode([x.encode() for x in texts], 1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == reference(texts)


def test_a_full_cache_keeps_its_most_used_words(monkeypatch):
    monkeypatch.setattr(R, "CACHED_WORDS", 8)
    rnd = random.Random(2)
    encode = R.WordEncoder(PATH)
    for _ in range(40):
        texts = [" ".join(rnd.choice(["often", "Naïve", f"word{rnd.randrange(60)}"]) for _ in range(rnd.randrange(12))) for _ in range(3)]
        ids, at = encode.encode([x.encode() for x in texts], 1)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == reference(texts)
    encode.shrink(4)
    assert len(encode) == 4 and b"often" in encode
    assert encode.encode([b"often new"], 1)[0].tolist() == reference(["often new"])[0]


def test_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["", None, "It's a Test " * rnd.randint(1, 400), "naïve <|endoftext|> x", "ab" * 5000])) for i in rnd.sample(range(10**6), 200)]
    rows += rows[:3] + [(None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    R.write_token_files(docs, str(tmp_path), PATH, file_bytes=3000)
    index = R.build_index(spark, str(tmp_path))
    got = R.with_starts(index).orderBy("start").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (doc_id, _), ids in zip(rows, reference([t for _, t in rows]), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    r = got[77]
    content = open(r.path.removeprefix("file:"), "rb").read()
    doc_id, ids = R.read_record(content, r.offset)
    assert (doc_id, zlib.crc32(ids.astype("<u4").tobytes())) == (r.doc_id, r.ids_crc32)
    broken = bytearray(content)
    broken[r.offset + 13] ^= 1
    with pytest.raises(ValueError):
        list(R.read_records(bytes(broken)))


def test_empty_table(spark):
    assert R.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

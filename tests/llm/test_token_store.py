import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochlake.llm import token_store as t

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 5000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64))
    ef = t.EliasFano.loads(t.EliasFano.of(values).dumps())
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small_and_checks():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000))
    assert len(t.EliasFano.of(values).dumps()) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 1
    with pytest.raises(ValueError):
        t.EliasFano.of(np.array([3, 1]))
    with pytest.raises(IndexError):
        t.EliasFano.of(np.array([1])).select(1)
    with pytest.raises(ValueError):
        t.Segment(b"something else")


TEXTS = ["", " ", "a", "Hello world", " lead", "trail ", "two  spaces", "a \n b", "a\n bar", "x\n \nbar", "tab\t x", "don't we'll 's", "é ü 漢字 かな", " nb sp", "<|endoftext|> in <|endoftext|>", "a<|endoftext|> b", "1234 5678", "\x1c x \x85y", "\r\n\r\n a", "emoji 😀 👨‍👩‍👧", "x" * 5000, "word " * 3000, "   ", "a   b    c"]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab '\n\t.1é  <|>")), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library(texts):
    encode = t.encoder(PATH)
    assert [np.frombuffer(b, "<u2").tolist() for b in encode(texts)] == [encode.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library_on_whole_tables(sf_dir):
    import pyarrow.parquet as pq

    encode = t.Encoder(PATH)
    texts = [x or "" for x in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()]
    want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(3):  # anew, from memory, and after rare pieces were dropped
        assert [np.frombuffer(b, "<u2").tolist() for b in encode(texts)] == want
        if k:
            known = encode.known
            encode.forget(3)
            assert 3 < encode.known < known


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ,.'éÿœɐ漢\u0301ªß")), max_size=20), max_size=6))
@settings(max_examples=150, deadline=None)
def test_plain_pieces(texts):
    encode = t.Encoder.__new__(t.Encoder)
    encode.__dict__.update(t.encoder(PATH).__dict__)
    encode.forget()
    assert [np.frombuffer(b, "<u2").tolist() for b in encode(texts)] == [encode.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_selects_give_offsets_without_a_table(monkeypatch):
    ids = np.arange(50_000, dtype="<u2")
    ends = np.sort(np.random.default_rng(1).integers(0, 50_001, 9_999))
    ends = np.append(ends, 50_000)
    names = [None, None, *range(-(2**63), -(2**63) + 9_000), *[2**63 - 1] * 998]
    s = t.Segment(t.pack(ids, ends, names))
    monkeypatch.setattr(t.EliasFano, "values", None)
    assert [s.doc_id(i) for i in (0, 1, 2, 9_001, 9_002, 9_999)] == [None, None, -(2**63), -(2**63) + 8_999, 2**63 - 1, 2**63 - 1]
    assert s.doc_ids(0, 10_000) == names
    for i in (0, 1, 77, 9_999):
        assert s[i].tolist() == ids[(ends[i - 1] if i else 0) : ends[i]].tolist()


def test_other_tokenizers_take_whole_texts():
    e = t.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(b, "<u2").tolist() for b in e(TEXTS[:6])] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in TEXTS[:6]]


def test_round_trip(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 101, x, i) for i, x in enumerate(TEXTS * 3)] + [(None, "null id", 0), (500, None, 0), (-4, "negative", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = t.encode_and_read_back(df, PATH, segment_ids=700).collect()
    key = lambda i: (i is not None, i or 0)
    at, want = 0, []
    for i, x, _ in sorted(rows, key=lambda r: key(r[0])):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=key)
    assert len({(r.part, r.seq) for r in got}) > 3


def test_empty(spark):
    assert t.encode_and_read_back(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

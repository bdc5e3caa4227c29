from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import range_coder as rc
from strandlake.llm import token_blocks as tb
from strandlake.llm.base import text_buffer


@given(st.lists(st.integers(0, 65535), max_size=300), st.sampled_from([1, 2, 7, 64]))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids, block):
    blocks, checks = rc.encode(np.array(ids, dtype=np.int64), block)
    assert rc.decode(blocks, checks, len(ids), block).tolist() == ids


@pytest.mark.parametrize("ids", [np.zeros(5000, np.int64), np.arange(5000) % 7, np.full(3000, 65535), np.random.default_rng(1).zipf(1.2, 20000) % 49408])
def test_round_trip_of_patterns(ids):
    blocks, checks = rc.encode(ids, 512)
    assert (rc.decode(blocks, checks, len(ids), 512) == ids).all()
    if len(set(ids.tolist())) < 10:
        assert sum(map(len, blocks)) < len(ids) // 2


def test_a_block_does_not_need_the_others():
    ids = np.random.default_rng(2).integers(0, 500, 700)
    blocks, checks = rc.encode(ids, 100)
    assert (rc.decode(blocks[3:4], checks[3:4], 100, 100) == ids[300:400]).all()


@given(st.lists(st.integers(0, 2**20 - 1), max_size=200), st.sampled_from([1, 3, 64]))
@settings(max_examples=30, deadline=None)
def test_round_trip_of_large_vocabularies(ids, block):
    blocks, checks = rc.encode(np.array(ids, dtype=np.int64), block, bits=20)
    assert rc.decode(blocks, checks, len(ids), block, bits=20).tolist() == ids


def test_blocks_in_groups_of_lanes(monkeypatch):
    ids = np.random.default_rng(4).zipf(1.3, 1000) % 3000
    whole = rc.encode(ids, 64)
    monkeypatch.setattr(rc, "LANES", 3)
    assert rc.encode(ids, 64) == whole
    assert (rc.decode(*whole, 1000, 64) == ids).all()


def test_smaller_than_zlib():
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SF_DIR}/documents.parquet")["text"].combine_chunks()
    ids, _ = tb.encoder(tb.default_tokenizer()).encode(*text_buffer(texts))
    blocks, _ = rc.encode(ids)
    assert sum(map(len, blocks)) < 0.9 * sum(len(zlib.compress(ids[k : k + rc.BLOCK].astype("<u2").tobytes(), 9)) for k in range(0, len(ids), rc.BLOCK))


MARKS = [*map(chr, range(0x300, 0x346)), "\u1dc0", "\u20d0", "\u05b0"]
LETTERS = [*"abIHTWYJKkİißÄäÖÉéñÿ×÷ƒŁΣσςǅ'.,;:-<>=|()!?019½ﬁ \u00a0\u0085\t\n\x1fÅÅΩ가각क़", "ᄀ", "ᅡ", "<|endoftext|>", "'s", "'T", "≮"]


@given(st.lists(st.lists(st.sampled_from(LETTERS) | st.sampled_from(MARKS), max_size=12).map("".join), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_words_encode_as_whole_texts(texts):
    words = tb.encoder(tb.default_tokenizer())
    ids, at = words.encode(*text_buffer(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_share_slots(monkeypatch):
    monkeypatch.setattr(tb.WordEncoder, "SLOTS", 4)
    words = tb.WordEncoder(tb.default_tokenizer())
    for text in ("one two three four five six seven eight nine ten", "ten nine eleven five twelve one", "one one two"):
        ids, _ = words.encode(*text_buffer(pa.array([text])))
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    words = tb.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Don't  stop, 12 of\n them", "", "éa  b"]
    ids, at = words.encode(*text_buffer(pa.array(texts)))
    assert not words.by_word
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_damage_is_found():
    blocks, checks = rc.encode(np.random.default_rng(3).integers(0, 9000, 400), 200)
    spoilt = bytearray(blocks[1])
    spoilt[10] ^= 4
    with pytest.raises(ValueError, match="block 1"):
        rc.decode([blocks[0], bytes(spoilt)], checks, 400, 200)
    with pytest.raises(ValueError):
        rc.encode(np.array([70000]))


def test_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tb, "SEGMENT", 3000)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = ["", None, " \n\t", "Don't STOP\x0bé\u00a0x\u2028y", "<|endoftext|> a<|startoftext|>b", "ÀÉ ﬁ ½ 12345", "end.\r\nNew", "it's,o'clock... (A)b-c_d!!e 's't ,.'d x,\u0301y <<|a|>> 3.5,a1,b é,è.", "a.b,c;;d''e\"f"]
    docs = docs.unionByName(spark.createDataFrame([(9000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    tb.write_blocks(docs, f"{tmp_path}/t", tb.default_tokenizer(), parts=5)
    tokenizer = Tokenizer.from_file(tb.default_tokenizer())
    start, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tb.digest(spark, f"{tmp_path}/t").collect()} == want
    assert tb.read_blocks(spark, f"{tmp_path}/t").count() == len(want)


def test_empty(spark, tmp_path):
    tb.write_blocks(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", tb.default_tokenizer(), parts=2)
    assert tb.digest(spark, f"{tmp_path}/e").count() == 0

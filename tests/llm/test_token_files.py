import pathlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossiermill.llm import token_files
from dossiermill.llm.memo import Memo

from .corpus import documents, frame, words

PATH = public_tokenizers.path(token_files.WORD_BPE)


def plain(texts):
    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def as_lists(found):
    return [np.frombuffer(x, np.uint32).tolist() for x in found]


def sequences():
    rng = np.random.default_rng(4)
    yield np.empty(0, np.uint32), 5
    yield np.array([7], np.uint32), 9
    yield np.arange(300, dtype=np.uint32), 300
    yield np.zeros(5000, np.uint32), 49_408
    yield rng.integers(0, 49_408, 20_001).astype(np.uint32), 49_408
    yield np.minimum(rng.zipf(1.3, 70_000), 40_000).astype(np.uint32), 49_408
    yield np.tile(rng.integers(0, 900, 700), 300).astype(np.uint32), 1_000
    yield np.repeat(rng.integers(0, 2, 40_000), 3).astype(np.uint32), 2
    yield np.concatenate([np.full(30_000, 3), rng.integers(0, 60_000, 3_000), np.full(30_000, 4)]).astype(np.uint32), 60_000


@pytest.mark.parametrize("n", range(9))
def test_round_trip(n):
    ids, vocabulary = list(sequences())[n]
    sizes, found = token_files.encode(ids, vocabulary)
    assert (token_files.decode(len(ids), sizes, found, vocabulary) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=900), st.integers(1, 6))
def test_round_trip_of_any_lanes(ids, lanes):
    ids = np.array(ids, np.uint32)
    own = token_files.LANES, token_files.LEAST_STEPS
    token_files.LANES, token_files.LEAST_STEPS = lanes, 3
    try:
        sizes, found = token_files.encode(ids, 41)
        assert (token_files.decode(len(ids), sizes, found, 41) == ids).all()
    finally:
        token_files.LANES, token_files.LEAST_STEPS = own


def test_size_is_near_the_entropy():
    """Independent ids cost little more than their entropy; repeats next to nothing."""
    rng = np.random.default_rng(1)
    p = 1 / np.arange(1, 2_001)
    ids = rng.choice(2_000, 1 << 18, p=p / p.sum()).astype(np.uint32)
    entropy = -(p / p.sum() * np.log2(p / p.sum())).sum() * len(ids) / 8
    assert token_files.encode(ids, 49_408)[1].nbytes < 1.12 * entropy
    again = np.tile(rng.permutation(2_000), 128).astype(np.uint32)
    assert token_files.encode(again, 49_408)[1].nbytes < 0.25 * len(again)


def test_mixed_shares_cover_the_line():
    """The shares of all ids are positive, end where the next begins, and are found."""
    rng = np.random.default_rng(2)
    model = token_files.Model(50, 6)
    for _ in range(40):
        model.look(6)
        low, size = zip(*(model.interval(np.full(6, i)) for i in range(50)), strict=True)
        low, size = np.array(low), np.array(size)
        assert (low[0] == 0).all() and (size > 0).all() and (low[1:] == (low + size)[:-1]).all() and (low[-1] + size[-1] <= token_files.TOTAL).all()
        for i in range(50):
            assert (model.find(low[i]) == i).all() and (model.find(low[i] + size[i] - 1) == i).all()
        model.learn(rng.integers(0, 3, 6) * rng.integers(1, 17, 6))


def test_damage_is_noticed():
    ids = np.arange(2_000, dtype=np.uint32) % 77
    block = token_files.pack([1, None], np.array([500, 1500]), ids, 100)
    numbers, lengths, got = token_files.unpack(block)
    assert (numbers, lengths.tolist(), got.tolist()) == ([1, None], [500, 1500], ids.tolist())
    for at in (token_files.HEADER.size + 3, len(block) - 5):
        with pytest.raises(ValueError):
            token_files.unpack(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError):
        token_files.unpack(block[:-1])
    # a payload whose own CRC fits still decodes to other ids
    (index,) = struct.unpack_from("<Q", block, token_files.HEADER.size)
    other = bytearray(block)
    other[token_files.HEADER.size + 8 + index] ^= 1
    head = list(token_files.HEADER.unpack_from(other))
    head[7] = zlib.crc32(other[token_files.HEADER.size :])
    with pytest.raises(ValueError):
        token_files.unpack(token_files.HEADER.pack(*head) + bytes(other[token_files.HEADER.size :]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "İ", "ΑΣ", "é", "e", "don't", "<|endoftext|>", "<|startoftext|>x", "日", "9", "🙂"]) | st.text(max_size=4), max_size=12))
def test_pieces_equal_whole_texts(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert as_lists(ENCODER([text])) == plain([text])


ENCODER = token_files.Encoder(PATH)


@pytest.mark.parametrize("block", [200, 1 << 19])
def test_files(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    rows = [*documents(n=40), (None, "none of it", None, None, 0), (-5, "x " * 70_000, None, None, 0)]
    docs = frame(spark, rows).withColumn("number", F.lit(1)).withColumn("file", F.lit("f"))
    files = token_files.write(docs, f"{tmp_path}/ids", PATH)
    assert sum(r.docs for r in files.collect()) == len(rows)
    assert sorted(r.file for r in files.collect()) == sorted(f"{tmp_path}/ids/{p.name}" for p in pathlib.Path(f"{tmp_path}/ids").iterdir())
    got = token_files.read(files).orderBy("start").collect()
    want = dict(zip([(r[0], r[1]) for r in rows], plain([r[1] for r in rows]), strict=True))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    texts = {}
    for (i, _), ids in want.items():
        texts.setdefault(i, []).append(ids)
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids in texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    short = token_files.read(files, digest_only=True)
    assert sorted(map(str, short.collect())) == sorted(str(x) for x in token_files.read(files).drop("ids").collect())


def test_no_documents(spark, tmp_path):
    files = token_files.write(frame(spark, []), f"{tmp_path}/none", PATH)
    assert token_files.read(files).count() == 0


def test_memo_forgets(monkeypatch):
    monkeypatch.setattr(token_files.Encoder, "KEPT", 5)
    own = token_files.Encoder(PATH)
    rng = random.Random(6)
    for _ in range(8):
        texts = [words(rng, 20, 30) for _ in range(4)] + [None, ""]
        assert as_lists(own(texts)) == plain(texts)
        assert len(own.ids.young) <= 5


def test_memo_keeps_what_is_used():
    asked = []
    memo = Memo(lambda keys: asked.extend(keys) or [k.upper() for k in keys], 3)
    for own in (["a", "b"], ["c", "d"], ["a"], ["e", "f", "g"], ["a", "b"], ["x" * 60, "a"]):
        assert memo(own) == [k.upper() for k in own]
    assert sorted(asked) == ["a", "b", "b", "c", "d", "e", "f", "g", "x" * 60] and "x" * 60 not in memo.young

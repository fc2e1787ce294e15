import collections
import hashlib
import itertools
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossiermill.llm import alignment

from .corpus import documents, frame, words

PATHS = public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE)
A, B = alignment.byte_bpe(PATHS[0]), alignment.piece_bpe(PATHS[1])


def whole(text):
    """(groups) of a whole text at once, by byte offsets where both sides end; None if the
    bytes differ or there is no text."""
    if not text:
        return None
    (a,), (b,) = A[0]([" " + text]), B[0]([" " + text])
    sides = [[of[i] for i in ids] for of, ids in ((A[1], a), (B[1], b))]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    ends = [list(itertools.accumulate(map(len, s))) for s in sides]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, before = [], 0
    for c in cuts:
        out.append(([i for i, e in zip(a, ends[0], strict=True) if before < e <= c], [i for i, e in zip(b, ends[1], strict=True) if before < e <= c]))
        before = c
    return out


def brute_force(rows):
    grouped = [(i, whole(t)) for i, t in rows]
    count = collections.Counter()
    for _, groups in grouped:
        count.update({(a, b) for x, y in groups or [] for a in x for b in y})
    highest = collections.defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for i, groups in grouped:
        links = [(a, b) for x, y in groups or [] for a in x for b in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups or [])
        out.append((i, sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


AWKWARD = [
    "ﬁne  spaces here \n\n x\ny", "a▁b and more", "tab\t\tend ", "  leading", "\x00nul \x1c sep", "日本語 の 文 章", "🙂🙂 emoji👩‍👩‍👧 x", "<|endoftext|> in <s>text</s> <unk> <0x41>", "é combining ́ x",
    "don't we'll I'M 123 4567 #$% x_y", "　wide　space", " line par\x85nel", "x" * 3000, " ", "\n", "﻿bom ​zero width", "\r\n\r\n a\r b",
]


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_against_whole_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", broadcast)
    rows = [r for r in documents(n=40) if r[0] != 1006] + [(2000 + n, t, None, None, 0) for n, t in enumerate(AWKWARD)] + [(None, "a b c", None, None, 0)]
    docs = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("links", F.lit(2))
    got = sorted((tuple(r) for r in alignment.alignments(docs, *PATHS).collect()), key=str)
    assert got == sorted(brute_force([(r[0], r[1]) for r in rows]), key=str)


def test_nothing(spark):
    assert alignment.alignments(frame(spark, []), *PATHS).count() == 0
    got = alignment.alignments(frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)]), *PATHS).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def by_units(text, aligner):
    found = aligner.units(alignment.units_of(" " + text)) if text else []
    return None if not found or any(x[3] is None for x in found) else ";".join(x[3] for x in found)


def as_text(groups):
    return None if groups is None else ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


ALIGNER = alignment.Aligner(A, B)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r", "a", "The", "ing", "'s", "9", "é", "é", "日", "▁", "🙂", " ", "​", "!!", "\x1c", "<|endoftext|>"]) | st.text(max_size=4), max_size=12))
def test_units_equal_whole_texts(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert by_units(text, ALIGNER) == as_text(whole(text))


def test_memos_may_be_cleared(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "MOVES", 3)
    own = alignment.Aligner(A, B)
    rng = random.Random(2)
    for _ in range(10):
        text = words(rng, 30, 12)
        assert by_units(text, own) == as_text(whole(text))
        # it is looked at before a unit
        assert len(own.transducer.moves) < 60


def test_transducer_by_hand():
    t = alignment.Transducer({0: b"ab", 1: b"c", 2: b"abc", 3: b"x"}, {0: b"a", 1: b"bc", 2: b"abc", 3: b"bcab"})
    assert t.groups([0, 1], [0, 1]) == [([0, 1], [0, 1])]
    assert t.groups([2, 2], [2, 0, 1]) == [([2], [2]), ([2], [0, 1])]
    assert t.groups([2, 0, 1], [0, 3, 1]) is None
    assert t.groups([2, 0], [0, 3]) == [([2, 0], [0, 3])]
    assert t.groups([3], [0]) is None and t.groups([0], []) is None and t.groups([], []) == []

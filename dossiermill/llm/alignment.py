"""Alignment of two tokenizers by a transducer over the dangling suffix.

Both token sequences spell the same bytes. Reading them from the left, one side leads and
the other owes the bytes by which it leads: that residual and the side are the whole
state. The next token of the side behind either shortens the residual, empties it, or
takes the lead with what it has over. Where the residual is empty both sides end at the
same byte and a group of tokens closes. Transitions are memoised by (side, residual,
token).

A single space between two letters or signs starts a new token in both vocabularies, so
the residual is empty there and a text is the sequence of such units. What a worker found
for a short unit it keeps in a bounded memo: tokenizers and transducer run once for each
different unit that it holds.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .memo import Memo

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

#: White space in any sense that a tokenizer might have.
_SPACE = r"\s\x1c-\x1f\x85\u200b\u2060\ufeff\u2581"
_UNIT = re.compile(rf"(?<=[^{_SPACE}])(?= [^{_SPACE}])")
#: Units in a generation of a worker's memo.
KEPT = 250_000
#: Transitions kept.
MOVES = 200_000
#: Pair counts of at most so many rows are broadcast (some 50 MB); beyond, they are joined
#: by key.
BROADCAST_ROWS = 2_000_000

DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_decoder() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand
    for themselves, the others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_bpe(path: str):
    """(encode, bytes of each id) of a byte-level vocabulary; its special tokens' strings
    are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    decode = byte_decoder()
    entries = {i: bytes(decode[c] for c in t) if all(c in decode for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], entries


def piece_bpe(path: str):
    """(encode, bytes of each id) of a piece vocabulary, which puts a space before each
    text itself; texts therefore begin with a space here, too, and lose it."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    entries = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for i, p in enumerate(names)}
    return lambda texts: pieces.encode([t[1:] for t in texts], num_threads=1), entries


class Transducer:
    """Groups of token ids of two sides that spell the same bytes. States are numbered:
    0 is the empty residual, where the first side moves."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.spelled = (a, b)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers = {(0, b""): 0}
        self.behind = [0]
        self.moves: dict[int, int] = {}

    def move(self, state: int, token: int) -> int:
        """The state after ``token`` of the side behind; -1 if its bytes contradict the
        residual."""
        behind, residual = self.states[state]
        own = self.spelled[behind][token]
        if len(own) <= len(residual):
            new = (behind, residual[len(own) :]) if residual.startswith(own) else None
        else:
            new = (1 - behind, own[len(residual) :]) if own.startswith(residual) else None
        if new is None:
            number = -1
        else:
            new = new if new[1] else (0, b"")
            number = self.numbers.setdefault(new, len(self.states))
            if number == len(self.states):
                self.states.append(new)
                self.behind.append(new[0])
        self.moves[state << 32 | token] = number
        return number

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups in order; None if the sides spell different bytes."""
        if len(self.moves) > MOVES:
            self.clear()
        moves, behind, out = self.moves, self.behind, []
        n, m, i, j, from_a, from_b, state = len(a), len(b), 0, 0, 0, 0, 0
        while i < n or j < m:
            # empty tokens leave the state where it is: then the other side moves
            if behind[state] == 0 and not (state == 0 and i > from_a):
                if i == n:
                    return None
                token = a[i]
                i += 1
                new = moves.get(state << 32 | token)
                state = self.move(state, token) if new is None else new
            else:
                if j == m or state == 0:
                    return None
                token = b[j]
                j += 1
                new = moves.get(state << 32 | token)
                state = self.move(state, token) if new is None else new
            if state < 0:
                return None
            if state == 0:
                if j == from_b:
                    return None
                out.append((a[from_a:i], b[from_b:j]))
                from_a, from_b = i, j
        return out if state == 0 else None


class Aligner:
    """What both tokenizers and the transducer make of units, with a memo."""

    def __init__(self, a, b):
        (self.encode_a, spelled_a), (self.encode_b, spelled_b) = a, b
        self.transducer = Transducer(spelled_a, spelled_b)
        self.spelled = (spelled_a, spelled_b)
        #: (n_a, n_b, groups, groups as text, link keys as bytes) of units; one whose bytes
        #: differ has None for its text. A link's key is A's id times 2^32 plus B's.
        self.units = Memo(self._made, KEPT)

    def _made(self, units: list[str]) -> list[tuple]:
        out = []
        # the tokenizers' own objects of many texts at once are large
        for lo in range(0, len(units), 4_096):
            part = units[lo : lo + 4_096]
            out += map(self._aligned, part, self.encode_a(part), self.encode_b(part))
        return out

    def _aligned(self, unit: str, a: list[int], b: list[int]) -> tuple:
        spelled = self.spelled[0]
        groups = self.transducer.groups(a, b) if b"".join([spelled[i] for i in a]) == unit.encode() else None
        if groups is None:
            return 0, 0, 0, None, b""
        keys, texts = array("q"), []
        for x, y in groups:
            if len(x) == len(y) == 1:
                texts.append(f"{x[0]}|{y[0]}")
                keys.append(x[0] << 32 | y[0])
            else:
                texts.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
                keys.extend([i << 32 | k for i in x for k in y])
        return len(a), len(b), len(groups), ";".join(texts), keys.tobytes()


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, which later tasks use again."""
    return Aligner(byte_bpe(path_a), piece_bpe(path_b))


def units_of(text: str) -> list[str]:
    """The pieces of a text that begins with a space, cut before single spaces between
    characters that are no white space."""
    return _UNIT.split(text)


def _aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, row, digest columns, links: distinct link keys, times: how often each)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for r in rows:
            lo = 0
            texts = r["text"].to_pylist()
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 1 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                yield batch(aligner, r.slice(lo, hi - lo), texts[lo:hi])
                lo = hi

    def batch(aligner: Aligner, r: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        cut = [units_of(" " + t) if t else [] for t in texts]
        found = iter(aligner.units([u for units in cut for u in units]))
        out, empty = [], np.empty(0, np.int64)
        for units in cut:
            own = islice(found, len(units))
            n_a, n_b, groups, as_text, links = zip(*own, strict=True) if units else ((), (), (), (None,), ())
            if None in as_text:
                out.append((0, 0, 0, 0, "", empty, empty))
                continue
            links = np.frombuffer(b"".join(links), np.int64)
            keys, times = np.unique(links, return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(groups), len(links), hashlib.sha256(";".join(as_text).encode()).hexdigest(), keys, times))
        *counts, digest, keys, times = zip(*out, strict=True)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        as_list = lambda parts, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(kind)))
        return pa.RecordBatch.from_pydict({
            "doc_id": r["doc_id"], **{n: pa.array(c, pa.int64()) for n, c in zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)},
            "groups_sha256": pa.array(digest, pa.string()), "links": as_list(keys, np.int64), "times": as_list(times, np.int32),
        })

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {DIGEST}, links array<long>, times array<int>")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """What ``alignments`` and ``pair_counts`` are made of: the documents' digests with
    their distinct links, and the pairs (link, a, b, count, best): in how many documents of
    the corpus the pair is linked, and whether no pair of its A id is in more.

    Rows are one for each of ``docs`` (doc_id, text), repeated or not."""
    common.batch_rows(docs.sparkSession)
    found = common.stored(_aligned_texts(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = found.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count"))
    counts = common.stored(counts.select("link", F.shiftright("link", 32).alias("a"), F.col("link").bitwiseAND((1 << 32) - 1).alias("b"), "count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return found, counts.join(highest, "a").select("link", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row
    of ``docs`` (doc_id, text), of two vocabularies' files: byte-level entries over space +
    text, and pieces over the text, which put a space before it themselves.

    A text that is null, empty, or spelled with other bytes by either side has zeros and an
    empty digest, and is in no count. Rows that share a doc_id are counted as documents of
    their own; an empty table gives no rows."""
    found, pairs = aligned(docs, path_a, path_b)
    pairs = common.stored(pairs.select("link", "count", "best"))
    each = found.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("link"), F.col("x.times").alias("times"))
    # rows of a row's links stand together, so partial sums leave one row each to shuffle
    small = pairs.count() <= BROADCAST_ROWS
    met = each.join(F.broadcast(pairs), "link") if small else common.spread_join(each, pairs, "link")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = found.drop("links", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both vocabularies aligned; nulls, empty texts, repeats and
    empty tables are as in ``alignments``."""
    import public_tokenizers

    return alignments(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))

"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers (k words; words of over LONGEST bytes count in pieces, so text
without spaces has k-mers too) are numbered by occurrence, and each numbered
k-mer is hashed. Each of SIGNATURES hash functions orders all k-mers of the text; the
two least under it are taken, put back into text order and hashed together. Moving text
changes the order, repeating it changes the numbers, so likeness of two fingerprints
(the share of functions that agree) falls with the edit distance and not only with the
sets. A text of one k-mer has that k-mer as both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .wordbytes import BASE, Words, batches, mix

K = 3
SIGNATURES = 64
LONGEST = 24

_BYTES = np.arange(256, dtype=np.uint8)
_IS_WORD = (_BYTES > 0x20) | ((_BYTES < 0x20) & (_BYTES > 0) & ((_BYTES < 9) | (_BYTES > 13)))


#: Low bits that hold a k-mer's place among those handled at once; the others order it.
_PLACE = np.uint64((1 << 20) - 1)


def signatures(texts: list[bytes]) -> np.ndarray:
    """(texts, SIGNATURES) uint16; all 0 for a text without words."""
    out = np.zeros((len(texts), SIGNATURES), dtype=np.uint16)
    for first, run in batches(texts):
        w = Words(run, _IS_WORD, _BYTES, LONGEST)
        text, numbered = _kmers(w)
        if len(text):
            begins = np.flatnonzero(np.diff(text, prepend=-1) != 0)
            out[first + text[begins]] = _signatures(numbered, begins)
    return out


def _kmers(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the occurrence-numbered k-mers in text order; a text of
    fewer than K words is one k-mer."""
    at = np.flatnonzero(w.whole(K))
    places, hashes = [at], [w.shingles(K)[at]]
    n = np.diff(w.first)
    for k in range(1, K):
        short = w.first[:-1][n == k]
        places.append(short)
        hashes.append(w.shingles(k)[short])
    place, kmer = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(place, kind="stable")
    text, kmer = w.text[place[order]], kmer[order]
    by = np.lexsort((kmer, text))  # equal k-mers of a text in text order
    new = (np.diff(text[by], prepend=-1) != 0) | (np.diff(kmer[by], prepend=~kmer[by[:1]]) != 0)
    at = np.arange(len(by))
    number = np.empty(len(by), dtype=np.uint64)
    number[by] = at - np.maximum.accumulate(np.where(new, at, 0))
    return text, mix(kmer + number * np.uint64(BASE))


def _signatures(kmers: np.ndarray, begins: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """(texts, SIGNATURES) of texts whose numbered k-mers begin at ``begins``. The least
    two come from minima over values that end in their place; with more k-mers than
    there are places, from a partial sort that orders alike."""
    out = np.empty((len(begins), SIGNATURES), dtype=np.uint16)
    if len(kmers) <= limit:
        place = np.arange(len(kmers), dtype=np.uint64)
        for k in range(SIGNATURES):
            value = _order(kmers, k) & ~_PLACE | place
            a = np.minimum.reduceat(value, begins)
            one = (a & _PLACE).astype(np.int64)
            value[one] = np.uint64(0xFFFFFFFFFFFFFFFF)
            b = np.minimum.reduceat(value, begins)
            other = np.where(b == np.uint64(0xFFFFFFFFFFFFFFFF), one, (b & _PLACE).astype(np.int64))
            out[:, k] = _tag(kmers[np.minimum(one, other)], kmers[np.maximum(one, other)])
        return out
    for k in range(SIGNATURES):
        value = _order(kmers, k) & ~_PLACE
        for n, (lo, hi) in enumerate(zip(begins, np.append(begins[1:], len(kmers)), strict=True)):
            own = value[lo:hi]
            least = np.argpartition(own, min(1, hi - lo - 1))[:2]
            cut = own[least].max()
            near = np.flatnonzero(own <= cut)
            two = near[np.argsort(own[near], kind="stable")[:2]] + lo
            out[n, k] = _tag(kmers[two.min() : two.min() + 1], kmers[two.max() : two.max() + 1])[0]
    return out


def _order(kmers: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function's values."""
    x = (kmers ^ np.uint64((k + 1) * BASE % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = mix(a * np.uint64(BASE) + b)
    return np.maximum(both & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the hash functions that agree; two texts without words are alike."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text); null is the
    empty text, whose fingerprint is all zeros."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            found = signatures([(t or "").encode() for t in r["text"].to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": r["doc_id"], "fingerprint": as_text(found)})

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt out in ranges of doc_id, each sorted downwards
    and closed by a guest row: the first row of the next range (of the first range
    after the last). Columns: doc_id, text, range, guest. Null doc_ids come last;
    rows that share a doc_id stand in the order of their text's hash."""
    ranges = 4 * common.parallelism(docs.sparkSession)
    share = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), F.lit(20 * ranges))).first()[0] or []
    bounds = sorted(set(bounds))

    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), ids.to_numpy(dtype=np.int64)).astype(np.int32))

    number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.pandas_udf(range_of, "int")(F.coalesce("doc_id", F.lit(0)).cast("long")))
    heads = docs.select("doc_id").withColumn("range", number).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    heads = sorted(((r["range"], r["doc_id"]) for r in heads), reverse=True)
    # the range before each head's range, cyclically, has it as its guest
    guest_of = [(doc_id, heads[n - 1][0]) for n, (_, doc_id) in enumerate(heads)]
    guest_ids = sorted((i, n) for i, n in guest_of if i is not None)
    null_guest = next((n for i, n in guest_of if i is None), None)
    ids, homes = [i for i, _ in guest_ids], [n for _, n in guest_ids]

    def guest_range(ids_: pd.Series) -> pd.Series:
        at = [bisect_left(ids, i) for i in ids_]
        return pd.Series([homes[n] if n < len(ids) and ids[n] == i else None for n, i in zip(at, ids_, strict=True)], dtype="Int32")

    guest = F.when(F.col("doc_id").isNull(), F.lit(null_guest).cast("int")).otherwise(F.pandas_udf(guest_range, "int")(F.coalesce("doc_id", F.lit(0)).cast("long")))
    rows = docs.select("doc_id", "text", number.alias("own"), guest.alias("as_guest"))
    place = lambda of, is_guest: F.struct(F.col(of).alias("range"), F.lit(is_guest).alias("guest"))
    places = F.when(F.col("as_guest").isNull(), F.array(place("own", False))).otherwise(F.array(place("own", False), place("as_guest", True)))
    rows = rows.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*")
    rows = rows.repartition(ranges, "range")
    return rows.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of every row of ``docs`` (doc_id, text): the edited text has the last
    third of the code points replaced by the first as many of the next document,
    downwards by doc_id and round. A single document is its own next. Null texts are
    empty, null doc_ids come last, rows that share a doc_id follow each other by their
    text's hash, and an empty table gives no rows. doc_id is of an integer type."""
    common.batch_rows(docs.sparkSession)

    def pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Lists of (doc_id, text, next text); a guest is a next only."""
        before = None
        for r in rows:
            out = []
            for doc_id, text, number, guest in zip(r["doc_id"].to_pylist(), r["text"].to_pylist(), r["range"].to_pylist(), r["guest"].to_pylist(), strict=True):
                if before and not before[3] and before[2] == number:
                    out.append((before[0], before[1], text or ""))
                before = (doc_id, text or "", number, guest)
            yield out

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in pairs(rows):
            lo = 0
            while lo < len(out):
                hi, total = lo, 0
                while hi < len(out) and (hi == lo or total < 1 << 18):
                    total += len(out[hi][1])
                    hi += 1
                part = out[lo:hi]
                lo = hi
                ids, texts, nexts = zip(*part, strict=True)
                edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
                edited = [t.encode() for t in edited]
                own = signatures([t.encode() for t in texts] + [nexts[-1].encode()])
                changed = signatures(edited)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, id_type), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                    "fingerprint": as_text(own[:-1]), "edited_fingerprint": as_text(changed),
                    "near_edited": likeness(own[:-1], changed), "near_next": likeness(own[:-1], own[1:]),
                })

    id_name = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {id_name}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text; nulls, empty texts,
    ties and empty tables are as in ``edit_likeness``."""
    return edit_likeness(common.table(spark, sf_dir, "documents"))

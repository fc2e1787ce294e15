"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows are runs of ``window`` consecutive words (a shorter item is one
window). A window's tokens are its shingles of up to three words. A document that
contains the window contains every one of its tokens, so one token is a
sufficient prefix; the rarest in the corpus is taken, by counts over all
documents. Documents emit only the places where a prefix token may stand (a Bloom
filter of set size decides, so nothing that grows is broadcast); those places are
joined to the windows by token, the window's place in the document is bounded by
the token's place in the window, and the words are compared one to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordbytes import Words, batches

WINDOW = 10
TOKEN_WORDS = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least and greatest size of a token filter, bits for each token, and probes.
FILTER_BITS = (1 << 16, 1 << 27)
BITS_PER_TOKEN, PROBES = 16, 4

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokenized(texts: Iterable[str | None]) -> Iterator[tuple[int, Words]]:
    for first, run in batches((t or "").encode() for t in texts):
        yield first, Words(run, _IS_WORD, _LOWER)


def token_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-word shingles."""
    at = np.flatnonzero(words.whole(k))
    return at, words.shingles(k)[at].view(np.int64)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, len): every window of every item that has words."""
    split = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = split.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    return each.select("item_id", F.array_join("words", " ").alias("words"), F.size("words").alias("len"))


def window_tokens(windows: DataFrame) -> DataFrame:
    """(words, len, offset, token): the tokens of each distinct window."""

    def tokens(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batch:
            for first, w in tokenized(rows["words"]):
                own = rows.iloc[first : first + len(w.first) - 1]
                for k in range(1, TOKEN_WORDS + 1):
                    at, token = token_hashes(w, k)
                    n = w.text[at]
                    fits = np.minimum(own["len"].to_numpy()[n], TOKEN_WORDS) == k
                    at, token, n = at[fits], token[fits], n[fits]
                    yield pd.DataFrame({"words": own["words"].to_numpy()[n], "len": own["len"].to_numpy()[n], "offset": at - w.first[n], "token": token})

    distinct = windows.select("words", "len").distinct()
    return distinct.mapInPandas(tokens, "words string, len int, offset int, token long")


def token_filter(tokens: DataFrame) -> tuple[Callable[[np.ndarray], np.ndarray], list[int]]:
    """A test for tokens (longs) that never misses one of ``tokens`` (token, len),
    and the token lengths in use: a Bloom filter with BITS_PER_TOKEN bits and PROBES
    places a token, which one other token in 400 passes. Its size is bounded by
    FILTER_BITS; with more tokens than it can tell apart it lets more through, and the
    join that follows stays exact."""
    n, *has = tokens.agg(F.count("*"), *(F.max(F.least("len", F.lit(TOKEN_WORDS)) == k) for k in range(1, TOKEN_WORDS + 1))).first()
    bits = FILTER_BITS[0]
    while bits < min(BITS_PER_TOKEN * n, FILTER_BITS[1]):
        bits *= 2
    step = F.shiftrightunsigned("token", 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.explode(F.array(*(F.pmod(F.pmod("token", F.lit(1 << 32)) + step * i, F.lit(bits)) for i in range(PROBES))))
    cells = tokens.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("cell"))
    found = cells.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))).alias("bits")).collect()
    field = np.zeros(bits // 64, dtype=np.uint64)
    if found:
        field[[r["cell"] for r in found]] = np.array([r["bits"] for r in found], dtype=np.int64).view(np.uint64)

    def maybe(token: np.ndarray) -> np.ndarray:
        t = token.view(np.uint64)
        low, step = t & np.uint64((1 << 32) - 1), (t >> np.uint64(32)) | np.uint64(1)
        left = np.arange(len(t))
        for i in range(PROBES):
            p = (low[left] + np.uint64(i) * step[left]) & np.uint64(bits - 1)
            left = left[(field[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(t), dtype=bool)
        out[left] = True
        return out

    return maybe, [k for k, x in enumerate(has, 1) if x]


def token_counts(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, df): in how many documents each of ``tokens`` occurs."""
    maybe, lengths = token_filter(tokens)

    def count(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batch:
            for _, w in tokenized(rows["text"]):
                for k in lengths:
                    at, token = token_hashes(w, k)
                    hit = maybe(token)
                    once = np.unique(np.stack([token[hit], w.text[at[hit]]]), axis=1)[0]
                    token, df = np.unique(once, return_counts=True)
                    yield pd.DataFrame({"token": token, "df": df})

    return docs.select("text").mapInPandas(count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def candidates(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, places) of each row of docs; a place is where a
    prefix token may stand: (token, pos, before, words) with the words around it,
    ``before`` of them before the token."""
    maybe, lengths = token_filter(prefixes)

    def find(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batch:
            places = [[] for _ in range(rows.num_rows)]
            n_words = np.zeros(rows.num_rows, dtype=np.int64)
            for first, w in tokenized(rows["text"].to_pylist()):
                n_words[first : first + len(w.first) - 1] = np.diff(w.first)
                for k in lengths:
                    at, token = token_hashes(w, k)
                    hit = maybe(token)
                    for p, t in zip(at[hit].tolist(), token[hit].tolist(), strict=True):
                        lo, hi = w.first[w.text[p]], w.first[w.text[p] + 1]
                        a, b = max(lo, p - window + 1), min(hi, p + window)
                        around = b" ".join(map(w.word, range(a, b))).decode()
                        places[first + w.text[p]].append({"token": t, "pos": int(p - lo), "before": int(p - a), "words": around})
            place = pa.struct({"token": pa.int64(), "pos": pa.int32(), "before": pa.int32(), "words": pa.string()})
            out = {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "n_words": n_words, "places": pa.array(places, pa.list_(place))}
            yield pa.RecordBatch.from_pydict(out)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, text_hash long, n_words long, places array<struct<token:long,pos:int,before:int,words:string>>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(find, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_words, hits, items) of every row of ``docs`` (doc_id,
    text): hits are the maximal word ranges (lo, hi) inside occurrences of windows
    of ``items`` (item_id, text), items the sorted item_ids (as strings) with a
    window in the text. text_hash is XXH64 of the text, and tells rows that share
    a doc_id apart; equal rows get equal results. Null and wordless texts have no
    words and no hits; items without words (and null item_ids) have no windows.
    Without items nothing is hit."""
    common.batch_rows(docs.sparkSession)
    windows = common.stored(item_windows(items.where("item_id is not null"), window))
    tokens = common.stored(window_tokens(windows))
    counts = token_counts(docs, tokens)
    rarity = F.struct(F.coalesce("df", F.lit(0)), "offset")
    prefixes = tokens.join(counts, "token", "left").groupBy("words", "len").agg(F.min_by(F.struct("token", "offset"), rarity).alias("prefix"))
    prefixes = common.stored(prefixes.select(F.col("words").alias("window"), "len", "prefix.*"))
    marked = common.stored(candidates(docs, prefixes, window))

    place = marked.select("doc_id", "text_hash", F.explode("places").alias("place")).select("doc_id", "text_hash", "place.*").distinct()
    skip = F.col("before") - F.col("offset")
    around = F.split("words", " ")
    fits = (skip >= 0) & (skip + F.col("len") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(skip, F.lit(0)) + 1, F.col("len")), " ") == F.col("window")
    hit = common.spread_join(place, prefixes, "token").where(fits & same)
    hit = hit.select("doc_id", "text_hash", "window", (F.col("pos") - F.col("offset")).alias("lo"), "len")
    hit = common.stored(hit)
    key = ["doc_id", "text_hash"]
    ranges = hit.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("lo", (F.col("lo") + F.col("len")).alias("hi")))).alias("hits"))
    named = windows.select("item_id", F.col("words").alias("window")).distinct()
    found = common.spread_join(hit.select(*key, "window").distinct(), named, "window")
    found = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = ranges.withColumn("hits", _merged("hits")).join(found, [ranges.doc_id.eqNullSafe(found.doc_id), ranges.text_hash == found.text_hash])
    both = both.select(ranges.doc_id.alias("_id"), ranges.text_hash.alias("_hash"), "hits", "items")
    out = marked.join(both, marked.doc_id.eqNullSafe(both._id) & (marked.text_hash == both._hash), "left")
    return out.select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("hits", F.array().cast("array<struct<lo:int,hi:int>>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _merged(ranges: str) -> Column:
    """Sorted ranges with those that touch or overlap made one."""
    last = lambda done: F.try_element_at(done, F.lit(-1))

    def add(done: Column, x: Column) -> Column:
        longer = F.struct(last(done)["lo"].alias("lo"), F.greatest(last(done)["hi"], x["hi"]).alias("hi"))
        joins = (F.size(done) > 0) & (last(done)["hi"] >= x["lo"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(ranges, F.array().cast("array<struct<lo:int,hi:int>>"), add)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside ten-word windows of benchmark items. Null and wordless
    texts have no words and are clean; rows that repeat get equal results; without items
    all are clean; an empty table gives no rows."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
  FROM low, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n),
hit AS (
  SELECT p.doc_id, p.s, p.n, i.item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM place) p
  JOIN item_window i ON i.win = p.win AND i.n = p.n),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

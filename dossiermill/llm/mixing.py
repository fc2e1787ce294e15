"""Mixing sources to target weights by fixed-length blocks.

The words of a source are one stream, cut into blocks of ``block_words``. A
source's target decides how many block slots it fills; for each output shard the
counts of slots by source are a multinomial draw on what the sources have left,
so the totals come out exact. The j-th slot of a source takes the block to which
a pseudorandom permutation of that source's block numbers sends j, a new
permutation each time round: no block is used a second time before all are used
once. Slots and blocks are joined by block number.

Weights, targets and draws are per source and stay on the driver (a row for each
source, and one for each source and output shard); all that is per document,
block or slot is distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
OUTPUT_SHARDS = 64
SEED = 20_251
CHUNK = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: ``share`` of all words by weight; a source stops at
    ``most`` times its own, and the excess is shared again among the others."""
    out, left, rest = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while rest:
        total = sum(weights[i] for i in rest)
        full = {i for i in rest if left * weights[i] / total >= most * sizes[i]}
        for i in full or rest:
            out[i] = most * sizes[i] if full else left * weights[i] / total
        left -= sum(out[i] for i in full)
        rest = rest - full if full else set()
    return out


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: each shard a multinomial draw on the slots left."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for n in range(shards):
        size = int(left.sum()) // (shards - n)
        if size:
            got = np.minimum(rng.multinomial(size, left / left.sum()), left)
            for i in np.argsort(got - left, kind="stable"):
                got[i] += min(size - got.sum(), left[i] - got[i])
            out[n], left = got, left - got
    return out


def permuted(index: Column, n: Column, key: Column) -> Column:
    return F.pandas_udf(permutation, "long")(index, n, key)


def permutation(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """Where a pseudorandom permutation of 0 to n-1, one for each key, sends index:
    a Feistel network over an even number of bits, walked until it is below n."""
    x, n, key = (s.to_numpy(dtype=np.uint64) for s in (index, n, key))
    half = (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(2)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    out = x.copy()
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for turn in range(4):
            f = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xD1B54A32D192ED03 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return pd.Series(out.astype(np.int64))


class Mix:
    """A drawn mix of ``docs`` (doc_id, text, source, ...).

    documents: (doc_id, text_hash, source, source_no, size, start), a row for each
    row of docs; start is the place of its first word in its source's stream.
    sources: (source_no, source, source_size, target, blocks).
    slots: (shard, slot, source_no, block), every slot of every output shard.

    Null texts have no words. Null is a source of its own, ordered last. Rows that
    repeat each have their own words in the stream. Without words, no slots."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED):
        spark = docs.sparkSession
        sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", n_words(F.col("text")).alias("size"))
        sized = common.stored(sized)
        totals = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
        names = sorted((x for x in totals if x is not None)) + [None] * (None in totals)
        sizes = [totals[x] for x in names]
        goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
        blocks = [-(-s // block_words) for s in sizes]
        slots = [min(2 * b, round(b * g / s)) if s else 0 for b, g, s in zip(blocks, goals, sizes, strict=True)]
        rows = [(i, x, s, float(g), b) for i, (x, s, g, b) in enumerate(zip(names, sizes, goals, blocks, strict=True))]
        self.block_words = block_words
        self.sources = spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, blocks long")
        known = sized.join(self.sources.select("source_no", F.col("source").alias("_name")), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        self.documents = common.stored(common.spread_starts(known, ["source_no"], "size", "start", ("size", "text_hash")))
        self.slots = self._slots(spark, draw(slots, shards, seed) if slots else np.zeros((0, 0), dtype=np.int64), blocks)

    def _slots(self, spark: SparkSession, counts: np.ndarray, blocks: list[int]) -> DataFrame:
        first = counts.cumsum(axis=0) - counts
        place = counts.cumsum(axis=1) - counts
        rows = [
            (n, i, blocks[i], int(first[n, i]), int(place[n, i]), int(counts[n, i]), int(counts[n].sum()))
            for n, i in zip(*map(np.ndarray.tolist, counts.nonzero()), strict=True)
        ]
        drawn = spark.createDataFrame(rows, "shard int, source_no int, blocks long, first long, place long, count long, filled long")
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(CHUNK).cast("long")))
        drawn = drawn.withColumn("lo", chunk).repartition(common.parallelism(spark))
        last = F.least(F.col("count"), F.col("lo") + CHUNK) - 1
        each = drawn.withColumn("k", F.explode(F.sequence(F.col("lo"), last)))
        j = F.col("first") + F.col("k")
        turn = F.floor(j / F.col("blocks"))
        return each.select(
            "shard", permuted(F.col("place") + F.col("k"), F.col("filled"), F.col("shard") + F.lit(1 << 40)).alias("slot"),
            "source_no", permuted(j % F.col("blocks"), F.col("blocks"), F.col("source_no") * F.lit(64) + turn).alias("block"),
        )

    def spans(self) -> DataFrame:
        """(source_no, start, block, lo, hi, uses): the words lo to hi - 1 of the
        document at start lie in a block that the mix uses so many times."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        b = self.block_words
        docs = self.documents.where("size > 0")
        ends = F.col("start") + F.col("size")
        parts = docs.select("source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((ends - 1) / b))).alias("block"))
        lo = F.greatest(F.col("block") * b - F.col("start"), F.lit(0).cast("long"))
        hi = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
        return parts.join(uses, ["source_no", "block"]).select("source_no", "start", "block", lo.alias("lo"), hi.alias("hi"), "uses")

    def taken(self) -> DataFrame:
        """documents with taken, the words that the mix takes (repeats counted)."""
        taken = self.spans().groupBy("source_no", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
        found = self.documents.where("size > 0").join(taken, ["source_no", "start"], "left")
        empty = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return found.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(empty)


def words_kept(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text from the first to the last word of each span (pairs of word
    numbers), the pieces joined by a line end. One span over all is the text."""
    import re

    out = []
    for t, s in zip(text, spans, strict=True):
        s = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in s]
        if s == [(0, -1)]:
            out.append(t)
            continue
        at = [m.span() for m in re.finditer(WORD, t, re.ASCII)]
        out.append("\n".join(t[at[lo][0] : at[hi - 1][1]] for lo, hi in s))
    return pd.Series(out)


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each document
    and time that the mix goes over it, holding just the words that this time
    takes (n_chars, if there, is counted again). Documents without taken words are
    left out. Rows that repeat in every column that matters (doc_id, text, source)
    are one row here."""
    common.batch_rows(docs.sparkSession)
    mix = Mix(docs.select("doc_id", "text", "source").dropDuplicates(), **options)
    spans = mix.spans().withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))))
    # neighbouring blocks taken in the same turn are one span
    kept = spans.groupBy("source_no", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] == x["lo"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["lo"].alias("lo"), x["hi"].alias("hi")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    kept = kept.join(mix.documents.where("size > 0"), ["source_no", "start"]).withColumn("spans", merged)
    whole = (F.size("spans") == 1) & (F.col("spans")[0]["lo"] == 0) & (F.col("spans")[0]["hi"] == F.col("size"))
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")))
    of_id, of_hash, of_source, taken = common.fresh(docs, "_id", "_hash", "_source", "_spans")
    kept = kept.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("source").alias(of_source), F.when(whole, all_).otherwise(F.col("spans")).alias(taken))
    rows = docs.dropDuplicates(["doc_id", "text", "source"])
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_hash)) & F.col("source").eqNullSafe(F.col(of_source))
    out = rows.join(kept, same).withColumn("text", F.pandas_udf(words_kept, "string")("text", taken))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document. Null, empty and wordless texts have
    size and taken 0; a null source is one of its own, last in order; rows that repeat each
    have their own share; an empty table gives no rows."""
    mix = Mix(common.table(spark, sf_dir, "documents"))
    return mix.taken().join(mix.sources.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", "taken")

"""Language identification by language-bitmask n-gram filters.

A language's profile is the set of character n-grams that are as frequent in it,
or nearly, as in any other language. All profiles go into one bit-sliced Bloom
filter: a table of bit masks with one bit for each language, so that the masks at
an n-gram's places, and-ed, name every language that has it. A text's n-grams are
looked up and counted for each language; the counts, less what false positives
are expected to add, decide.

Profiles are fitted on a bounded sample of the labelled rows (about
``SAMPLE_DOCS`` documents a language, chosen by a hash of doc_id); the filter has
``PROFILE`` n-grams a language at most and is broadcast. Everything else runs
over whole texts of all documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordbytes import BASE, mix

SIZES = (3, 4)
SAMPLE_DOCS = 2_000
PROFILE = 20_000
KEEP_RATIO = 0.25
MIN_DOCS = 2
PROBES = 3
BITS_PER_GRAM = 24
UND = "und"
#: Texts of which less than this is known to the chosen language are rejected by the filter.
MIN_KNOWN = 0.1

_letters: list[np.ndarray] = []


def letter_kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark (part of the words that
    letters make, but no letter), else 0."""
    if not _letters:
        _letters.append(np.array(["ML".find(unicodedata.category(chr(i))[0]) + 1 for i in range(0x110000)], dtype=np.uint8))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each n-gram of the lower-cased words, word ends marked; a
    text without letters has no n-grams."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    number = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    number = np.concatenate((number, [len(low) - 1]))[: len(points)]
    kind = letter_kinds()[points]
    has_letter = np.bincount(number[kind == 2], minlength=len(low))[: len(low)] > 0
    letter = (kind > 0) & has_letter[number]
    keep = letter | np.concatenate(([True], letter[:-1]))
    points, letter, number = np.where(letter, points, 0)[keep].astype(np.uint64), letter[keep], number[keep]
    texts_of, hashes = [], []
    for n in SIZES:
        m = max(0, len(points) - n + 1)
        h, inside = np.full(m, n, dtype=np.uint64), np.ones(m, dtype=bool)
        for i in range(n):
            h = h * np.uint64(BASE) + points[i : m + i]
            if 0 < i < n - 1:
                inside &= letter[i : m + i]
        texts_of.append(number[1 : m + 1][inside])
        hashes.append(mix(h[inside]))
    return np.concatenate(texts_of), np.concatenate(hashes)


def in_pieces(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, list[str | None]]]:
    first, total = 0, 0
    for n, t in enumerate(texts):
        if n > first and total + len(t or "") > size:
            yield first, texts[first:n]
            first, total = n, 0
        total += len(t or "")
    if first < len(texts):
        yield first, texts[first:]


class Filter:
    """The bit-sliced filter: ``masks[place, word]`` over 64 languages a word."""

    def __init__(self, langs: list[str], profiles: list[np.ndarray]):
        self.langs = langs
        most = max([1, *map(len, profiles)])
        self.places = 1 << int(np.ceil(np.log2(BITS_PER_GRAM * most)))
        self.masks = np.zeros((-(-len(langs) // 64), self.places), dtype=np.uint64)
        for n, grams_ in enumerate(profiles):
            for p in self._places(grams_):
                np.bitwise_or.at(self.masks[n // 64], p, np.uint64(1) << np.uint64(n % 64))
        fill = [float(((self.masks[n // 64] >> np.uint64(n % 64)) & np.uint64(1)).mean()) for n in range(len(langs))]
        self.false = np.array(fill) ** PROBES

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(self.places - 1)).astype(np.int64) for i in range(PROBES)]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of n-grams, and (texts, languages) of how many of
        them each language has, corrected for false positives."""
        number, h = grams(texts)
        n = np.bincount(number, minlength=len(texts))[: len(texts)]
        places = self._places(h)
        out = np.zeros((len(texts), len(self.langs)))
        for word, masks in enumerate(self.masks):
            has = masks[places[0]] & masks[places[1]] & masks[places[2]]
            some = np.flatnonzero(has)
            has, where = has[some], number[some]
            for lang in range(64 * word, min(64 * (word + 1), len(self.langs))):
                bit = (has >> np.uint64(lang % 64)) & np.uint64(1)
                out[:, lang] = np.bincount(where[bit == 1], minlength=len(texts))[: len(texts)]
        return n, np.maximum(0, (out - n[:, None] * self.false) / (1 - self.false))


def hashed_share(*columns: str) -> Column:
    """A number from 0 to 1 that depends only on the columns' values."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE) -> Filter:
    """Fits on ``docs`` (doc_id, text, lang); rows without text or lang are no help.
    Languages are ordered by how many rows they have."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return Filter([], [])
    spark = docs.sparkSession
    rates = spark.createDataFrame([(n, x, min(1.0, sample_docs / sizes[x])) for n, x in enumerate(langs)], "number int, lang string, rate double")
    sample = known.join(F.broadcast(rates), "lang").where(hashed_share("doc_id") < F.col("rate")).select("number", "text")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            numbers, texts = r["number"].to_numpy(), r["text"].to_pylist()
            for first, piece in in_pieces(texts):
                text, h = grams(piece)
                order = np.lexsort((text, h))
                text, h = text[order], h[order]
                once = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(h, prepend=~h[:1]) != 0))
                key = np.stack([h[once].view(np.int64), numbers[first + text[once]].astype(np.int64)])
                key, df = np.unique(key, axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": key[0], "number": key[1], "df": df})

    found = sample.mapInArrow(count, "gram long, number long, df long").groupBy("gram", "number").agg(F.sum("df").alias("df"))
    drawn = {r["number"]: r["count"] for r in sample.groupBy("number").count().collect()}
    per_doc = spark.createDataFrame([(int(n), 1.0 / c) for n, c in drawn.items()], "number long, per_doc double")
    rated = common.stored(found.where(F.col("df") >= MIN_DOCS).join(F.broadcast(per_doc), "number").withColumn("rate", F.col("df") * F.col("per_doc")))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.join(best, "gram").where(F.col("rate") >= F.col("best") * KEEP_RATIO)
    profiles = [np.array([r["gram"] for r in kept.where(F.col("number") == n).orderBy(F.desc("rate"), "gram").select("gram").limit(profile).collect()], dtype=np.int64).view(np.uint64) for n in range(len(langs))]
    return Filter(langs, profiles)


def predict(docs: DataFrame, model: Filter, added: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """``docs`` (text, ...) with the columns ``added``: the language, its share
    of what the first two languages have (0.5 to 1), and the share of the text's
    n-grams that it has. Null texts and texts without letters are ``und`` with score
    0; a text with letters of which no language knows anything gets the most common
    language with score 0."""
    common.batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for r in rows:
            texts = r["text"].to_pylist()
            pred, score, known = [], [], []
            for _, piece in in_pieces(texts):
                n, has = model.counts(piece)
                if not model.langs:
                    pred += [UND] * len(piece)
                    score.append(np.zeros(len(piece)))
                    known.append(np.zeros(len(piece)))
                    continue
                best = has.argmax(axis=1)
                top = np.sort(has, axis=1)[:, ::-1]
                second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(piece))
                pred += [model.langs[b] if m else UND for b, m in zip(best, n, strict=True)]
                score.append(np.where(top[:, 0] > 0, top[:, 0] / np.maximum(top[:, 0] + second, 1e-9), 0.0))
                known.append(top[:, 0] / np.maximum(n, 1))
            empty = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [*(r[c] for c in names), pa.array(pred, pa.string()), pa.array(np.concatenate(empty + score)), pa.array(np.minimum(1, np.concatenate(empty + known)))],
                [*names, *added],
            )

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)]))


def held_out(doc_id: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) whose language is known, by a filter fitted
    on their own labels; rejected are texts without letters and texts of which the
    chosen language knows less than MIN_KNOWN. All columns stay as they are."""
    pred, score, known = common.fresh(docs, "_pred", "_score", "_known")
    found = predict(docs, fit(docs), (pred, score, known))
    return found.where((F.col(pred) != UND) & (F.col(known) >= MIN_KNOWN)).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out.
    Null texts and texts without a letter (marks are none) are ``und`` with score 0; rows
    that repeat get equal results; an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")

"""The corpus pipeline: five stages, each a table written and read again.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on, with
the columns of ``documents``; the last one adds their shard and slot.

Null, empty and letterless texts go in the first stage. Rows that repeat in doc_id and
text are one row from the second stage on; other columns of ``documents`` stay as they
are, whatever their names, but for size, shard and slot, which the last stage replaces. An
empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiermill.llm import common, decontamination, language_id, mixing, sharding, simhash

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled rows teach; others go."""
    return language_id.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return simhash.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select("doc_id", "text_hash").distinct()
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.doc_id) & (F.xxhash64(docs.text) == hit.text_hash), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: the words drawn, by document."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards of near equal bytes, equal texts together."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: A fitted language filter and drawn blocks have no SQL form; tests/llm holds the
#: near-duplicate and decontamination stages against all pairs and all windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages. A stage's table is deleted when the
    next one is written; the last one's input stays for the returned plan."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = f"{common.shared_dir(spark)}/stage-{n}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                common.remove(spark, before)
            before = path
    return docs

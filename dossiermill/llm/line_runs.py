"""Exact line deduplication over levelled sorted runs of line keys.

A run is a table of (key, n_docs, last_doc), bucketed and sorted by key, with one file
a bucket: a join or a merge of runs needs no exchange on their side. Runs are disjoint.
A batch of documents is reduced to its keys, which are merge-anti-joined with the runs
that are there; the keys left over are new and become a run of level 0. The others
were seen before and go to the table of recurrences, (key, n_docs, last_doc) as well.
When a level holds ``FANOUT`` runs they are compacted into one run of the next level, so
n batches leave O(log n) runs and a key is rewritten O(log n) times.

What the anti-joins decide is what the result is read from: a key is in as many documents
as its run says and its recurrences add, so keys that never recur are looked at only
where their own batch already has them often enough.

DataFrame functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FANOUT = 3
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """A text's lines; null and the empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_text(line: Column) -> Column:
    """What lines are compared by: ends stripped of white space, A-Z lowered."""
    return common.ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, key) of each line of at least ``min_chars`` code points; the
    key is the 128-bit MD5 of the line's compared text."""
    line = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    line = line.select("doc_id", "pos", line_text(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    return line.select("doc_id", "pos", F.unhex(F.md5("line")).alias("key"))


class LineRuns:
    """The levelled runs. ``add`` takes one batch of (doc_id, key) rows; a document
    belongs to one batch. ``repeated`` is (key, n_docs, last_doc) of the keys that are in
    ``min_docs`` documents or more. ``drop`` removes all tables."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.recurrences = spark, fanout, [[]], []

    def add(self, batch: DataFrame) -> None:
        """Adds a batch: a run of the keys that no earlier run has, and the recurrences."""
        own = batch.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        own = self._run(own)
        fresh = own
        for run in self._runs():
            fresh = fresh.join(run.select("key"), "key", "left_anti")
        if self._runs():
            new = self._run(fresh)
            self.recurrences.append(self._run(own.join(new.select("key"), "key", "left_anti")))
            self._drop(own)
        else:
            new = own
        self.levels[0].append(new)
        self._compact()

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _run(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a sorted run in the shared folder. The rows of a bucket come from
        one task, since they are dealt out by key into as many parts as buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = common.parallelism(self.spark)
        dealt = rows.repartition(buckets, "key")
        dealt.write.bucketBy(buckets, "key").sortBy("key").saveAsTable(name, path=f"{common.shared_dir(self.spark)}/{name}", format="parquet")
        run = self.spark.table(name)
        run._stored_at = name
        return run

    def _drop(self, *runs: DataFrame) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run._stored_at}")
            common.remove(self.spark, f"{common.shared_dir(self.spark)}/{run._stored_at}")

    def _compact(self) -> None:
        for n, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(self._run(reduce(DataFrame.unionByName, level)))
                self._drop(*level)
                self.levels[n] = []

    def repeated(self, min_docs: int) -> DataFrame:
        """The keys in ``min_docs`` documents or more; a table of its own."""
        seen = [r.select("key", F.col("n_docs").alias("n_more"), F.col("last_doc").alias("last_more")) for r in self.recurrences]
        often = []
        for run in self._runs():
            if seen:
                more = reduce(DataFrame.unionByName, seen).groupBy("key").agg(F.sum("n_more").alias("n_more"), F.max("last_more").alias("last_more"))
                run = run.join(more, "key", "left")
                run = run.select("key", (F.col("n_docs") + F.coalesce("n_more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last_more").alias("last_doc"))
            often.append(run.where(F.col("n_docs") >= min_docs).select("key", "n_docs", "last_doc"))
        return common.stored(reduce(DataFrame.unionByName, often))

    def drop(self) -> None:
        self._drop(*self._runs(), *self.recurrences)
        self.levels, self.recurrences = [[]], []


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``docs`` (doc_id, text).
    A line whose compared text has ``min_chars`` code points or more and is in
    ``min_docs`` documents or more goes, except from the largest doc_id that has
    it. Null and empty texts are one empty line; rows that share a doc_id are one
    document for counting and each lose the lines that any of them loses at the
    same place; a null doc_id is an ordinary document that is never the largest. An
    empty table gives no rows; other columns are not looked at."""
    keys = common.stored(line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")))
    runs = LineRuns(docs.sparkSession, fanout)
    for n in range(batches):
        runs.add(keys.where(F.col("batch") == n).select("doc_id", "key"))
    repeated = runs.repeated(min_docs).select("key", "last_doc")
    runs.drop()
    # a repeated key is on min_docs rows at least, and may be on a third of all
    gone = common.spread_join(keys.select("doc_id", "pos", "key"), repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("of"), "gone")
    lines = docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    lines = lines.select("doc_id", lines_of(F.col("text")).alias("line"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.array_join("line", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("line", p)), "\n"))
    return lines.select("doc_id", F.size("line").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 40 code points or more that five documents
    have, but for the last of them. Nulls, empty texts, repeats and empty tables are as
    in ``drop_repeated_lines``."""
    out = drop_repeated_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

"""Findings on looked-up identities, and reports over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, identities, reports
from ..sources import files
from . import derived, grading
from .queries import GRADED, query


def looked_up(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, candidates, errors): every number's first part decides what its lookup
    returned."""
    parts = derived.components(spark, sf_dir).where("cas <> ''").select("doc", "pos", "cas")
    k = F.substring("cas", 1, 5).cast("int")
    numbers = parts.select("cas").distinct().withColumn("k", k)
    structure = F.when(F.col("k") % 5 == 0, "missing").when(F.col("k") % 5 == 1, "invalid").otherwise("normalized")
    calculated = F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 3 == 0, "C3H8").otherwise("C2H6O")
    some = numbers.where("k % 4 > 0").withColumn("j", F.explode(F.sequence(F.lit(1), (F.col("k") % 4).cast("int"))))
    candidates = some.select("cas", (F.col("k") + F.floor(F.col("j") / 3)).alias("cid"), F.lit("C2H6O").alias("formula"), structure.alias("structure"), calculated.alias("calculated"), (1 + F.col("k") % 2).alias("fragments"))
    return parts, candidates, numbers.where("k % 8 = 0").select("cas", F.lit("timed out").alias("message"))


@query("WITH " + derived.COMPONENTS_SQL + """,
c AS (SELECT doc, pos, cas, status, body AS k FROM components WHERE cas <> '')
SELECT doc, pos, cas, 'LOW' AS level, 'GEN-CAS-ENRICHMENT-MISSING' AS rule FROM c WHERE status = 'ok' AND k % 4 IN (0, 3)
UNION ALL SELECT doc, pos, cas, 'HIGH', 'GEN-CAS-AMBIGUOUS' FROM c WHERE k % 4 = 3
UNION ALL SELECT doc, pos, cas, 'LOW', 'GEN-STRUCTURE-MISSING' FROM c WHERE k % 4 IN (1, 2) AND k % 5 = 0
UNION ALL SELECT doc, pos, cas, 'MED', 'GEN-STRUCTURE-INVALID' FROM c WHERE k % 4 IN (1, 2) AND k % 5 = 1
UNION ALL SELECT doc, pos, cas, 'HIGH', 'GEN-STRUCTURE-FORMULA-MISMATCH' FROM c WHERE k % 4 IN (1, 2) AND k % 5 > 1 AND k % 3 = 0 AND k % 7 <> 0
UNION ALL SELECT doc, pos, cas, 'MED', 'GEN-STRUCTURE-MULTIFRAGMENT' FROM c WHERE k % 4 IN (1, 2) AND k % 5 > 1 AND k % 2 = 1
UNION ALL SELECT doc, pos, cas, 'MED', 'GEN-CAS-LOOKUP-ERROR' FROM c WHERE status = 'ok' AND k % 8 = 0""")
def identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, candidates, errors = looked_up(spark, sf_dir)
    return identities.identity_findings(identities.identified(parts, identities.outcomes(candidates, errors)))


@query("WITH " + derived.COMPONENTS_SQL + """,
c AS (SELECT doc, pos, cas, body AS k FROM components WHERE cas <> '')
SELECT doc, pos, cas, CASE WHEN k % 8 = 0 THEN 'error' WHEN k % 4 IN (1, 2) THEN 'resolved' WHEN k % 4 = 3 THEN 'ambiguous' END AS outcome,
  CASE WHEN k % 4 IN (1, 2) AND NOT (k % 5 > 1 AND k % 3 = 0 AND k % 7 <> 0) THEN 'C2H6O' END AS published_formula FROM c""")
def published_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, candidates, errors = looked_up(spark, sf_dir)
    return identities.identified(parts, identities.outcomes(candidates, errors)).select("doc", "pos", "cas", "outcome", "published_formula")


@query(GRADED + " SELECT doc, CAST(100 * crit + 10 * high + med AS BIGINT) AS badness FROM graded ORDER BY badness DESC, doc LIMIT 5")
def worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.worst(grading.graded(spark, sf_dir), "doc", 5).select("doc", "badness")


SCORES_SQL = """
WITH scores AS (SELECT l_orderkey AS doc, 'S' || l_linenumber AS section, l_suppkey % 3 = 0 AS full_text, CASE WHEN l_partkey % 13 <> 0 THEN (l_partkey % 11)::DOUBLE / 10.0::DOUBLE END AS score FROM lineitem),
files AS (SELECT doc, count(score) AS n, round(coalesce(avg(score), 0.0::DOUBLE), 6) AS retention, round(avg(CASE WHEN full_text THEN score END), 6) AS full_text_retention FROM scores GROUP BY doc)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    score = F.when(part % 13 != 0, (part % 11).cast("double") / 10.0)
    return derived.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("section"), (F.col("l_suppkey") % 3 == 0).alias("full_text"), score.alias("score"))


@query(SCORES_SQL + " SELECT section, count(*) AS n, round(avg(score), 6) AS retention FROM scores WHERE score IS NOT NULL GROUP BY section")
def retention_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retention_by_section(scores(spark, sf_dir))


@query(SCORES_SQL + " SELECT doc, n, retention, full_text_retention FROM files")
def retention_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retention_by_file(scores(spark, sf_dir))


@query(SCORES_SQL + """ SELECT count(*) AS n_docs, round(avg(retention), 6) AS mean_retention, round(avg(full_text_retention), 6) AS mean_full_text_retention,
  (SELECT doc FROM files ORDER BY retention DESC, doc LIMIT 1) AS best, (SELECT doc FROM files ORDER BY retention, doc LIMIT 1) AS worst FROM files""")
def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retention_summary(reports.retention_by_file(scores(spark, sf_dir)))


@query("""
WITH v AS (SELECT l_suppkey % 5 AS seed, 'f' || l_linenumber AS feature, CASE WHEN l_partkey % 9 = 0 THEN 0.0::DOUBLE ELSE (l_partkey % 17 - 8)::DOUBLE / 10.0::DOUBLE END AS value FROM lineitem),
s AS (SELECT seed, feature, avg(abs(value)) AS m FROM v GROUP BY seed, feature)
SELECT feature, round(avg(m), 6) AS mean_abs, round(stddev_samp(m), 6) AS std_abs FROM s GROUP BY feature""")
def feature_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    value = F.when(part % 9 != 0, (part % 17 - 8).cast("double") / 10.0)
    rows = derived.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("seed"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), value.alias("value"))
    return reports.attribution(rows)


@query("WITH " + derived.DOCUMENTS_SQL + """,
n AS (SELECT 'in/' || doc AS path, 'SDS_' || replace(issue_date, '-', '') || '_' || CASE WHEN doc % 3 = 0 THEN supplier WHEN doc % 41 = 0 AND doc % 37 <> 0 THEN 'NoCode' WHEN doc % 37 = 0 THEN 'N_A' ELSE 'Product_' || doc END AS name FROM docs),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5(path), path) - 1 AS nth FROM n)
SELECT path, name || CASE WHEN nth > 0 THEN printf('_%03d', nth) ELSE '' END AS file_name FROM r""")
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.documents(spark, sf_dir)
    number = F.when(F.col("doc") % 3 == 0, F.col("supplier"))
    named = docs.select(F.concat(F.lit("in/"), F.col("doc").cast("string")).alias("path"), files.suggested_name(F.col("issue_date"), number, F.col("trade_name")).alias("name"))
    return reports.numbered_names(named).select("path", "file_name")

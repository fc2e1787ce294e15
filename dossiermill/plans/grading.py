"""The flagship plan: grade every document of a corpus and rank its failing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import corpus, validator
from . import derived


def component_findings(spark: SparkSession, sf_dir: str, **counts: Column) -> DataFrame:
    """(doc, findings): the findings of the component rules, one row a document. A number
    counts as a duplicate if it is valid and stands earlier in the document. ``counts`` are
    more aggregates of a document's components and their ``status``, by name."""
    # the status once a row, before the rows of a document meet
    parts = derived.components(spark, sf_dir).withColumn("status", chemistry.cas_status(F.col("cas"), chemistry.QC_CAS_FORMAT))
    per_doc = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "cas", "status"))).alias("c"), F.round(F.sum("conc"), 6).alias("total"), F.count("*").alias("n"), *(c.alias(name) for name, c in counts.items()))
    rule = lambda level, name: F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))
    none = F.array().cast("array<struct<level:string,rule:string>>")
    bad = F.filter("c", lambda e: (e["cas"] != "") & (e["status"] == "format"))
    wrong = F.filter("c", lambda e: (e["cas"] != "") & (e["status"] == "checkdigit"))
    valid = F.transform(F.filter("c", lambda e: (e["cas"] != "") & (e["status"] == "ok")), lambda e: e["cas"])
    again = F.filter(valid, lambda x, i: F.array_position(valid, x) <= i)
    all_ = F.concat(
        F.transform(bad, lambda e: rule("HIGH", "S3-CAS-FORMAT")),
        F.transform(wrong, lambda e: rule("HIGH", "S3-CAS-CHECKDIGIT")),
        F.transform(again, lambda e: rule("MED", "S3-DUPLICATE-CAS")),
        F.when((F.col("n") > 1) & (F.col("total") > 102), F.array(rule("MED", "S3-CONC-SUM-EXCEEDS"))).otherwise(none),
    )
    return per_doc.select("doc", F.transform(all_, lambda f: F.struct(f["level"].alias("level"), f["rule"].alias("rule"), F.lit("").alias("message"))).alias("findings"), *counts)


def graded(spark: SparkSession, sf_dir: str, profile: str = "py", **counts: Column) -> DataFrame:
    """Documents with findings, severities, score and grade, and ``counts`` of their
    components, which are null without components."""
    found = component_findings(spark, sf_dir, **counts)
    docs = derived.documents(spark, sf_dir).join(found, "doc", "left")
    docs = docs.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<level:string,rule:string,message:string>>")))
    return corpus.scored(docs, profile)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("doc", "supplier", F.explode("findings").alias("f")).select("doc", "supplier", "f.level", "f.rule")


def validated(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    return validator.validate(derived.records(spark, sf_dir), names)


FINDINGS_SQL = (
    derived.COMPONENTS_SQL
    + """,
valid AS (SELECT doc, pos, cas, row_number() OVER (PARTITION BY doc, cas ORDER BY pos) AS nth FROM components WHERE status = 'ok'),
facts AS (
  SELECT doc, 'HIGH' AS level, 'S3-CAS-FORMAT' AS rule FROM components WHERE status = 'format' AND cas <> ''
  UNION ALL SELECT doc, 'HIGH', 'S3-CAS-CHECKDIGIT' FROM components WHERE status = 'checkdigit'
  UNION ALL SELECT doc, 'MED', 'S3-DUPLICATE-CAS' FROM valid WHERE nth > 1
  UNION ALL SELECT doc, 'MED', 'S3-CONC-SUM-EXCEEDS' FROM components GROUP BY doc HAVING count(*) > 1 AND round(sum(conc), 6) > 102)"""
)


def graded_sql(profile: str = "py") -> str:
    a, b, c = {"py": (35.0, 8.0, 1.5), "cli": (40.0, 5.0, 1.0)}[profile]
    return (
        FINDINGS_SQL
        + ","
        + derived.DOCUMENTS_SQL
        + f""",
counted AS (
  SELECT d.*, CAST(count(*) FILTER (WHERE f.level = 'CRIT') AS INTEGER) AS crit, CAST(count(*) FILTER (WHERE f.level = 'HIGH') AS INTEGER) AS high, CAST(count(*) FILTER (WHERE f.level = 'MED') AS INTEGER) AS med
  FROM docs d LEFT JOIN facts f ON f.doc = d.doc GROUP BY ALL),
scored AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - {a}::DOUBLE * crit - {b}::DOUBLE * high - {c}::DOUBLE * med) AS score FROM counted),
graded AS (
  SELECT *, CASE WHEN crit = 0 AND high <= 0 AND score >= 90 THEN 'A' WHEN crit = 0 AND high <= 3 AND score >= 80 THEN 'B' WHEN crit = 0 AND high <= 10 AND score >= 65 THEN 'C' ELSE 'D' END AS grade FROM scored)"""
    )

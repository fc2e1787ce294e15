"""The registered queries of the reference operators, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import corpus, rules
from . import derived, grading

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


GRADED = "WITH " + grading.graded_sql()


@query(GRADED + " SELECT grade, count(*) AS n_docs, round(avg(score), 6) AS mean_score, CAST(sum(high) AS BIGINT) AS n_high, CAST(sum(med) AS BIGINT) AS n_med FROM graded GROUP BY grade")
def corpus_grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grade_summary(grading.graded(spark, sf_dir))


@query(GRADED + " SELECT count(*) AS n_docs, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE grade = 'A') AS grade_a, count(*) FILTER (WHERE grade = 'B') AS grade_b, count(*) FILTER (WHERE grade = 'C') AS grade_c, count(*) FILTER (WHERE grade = 'D') AS grade_d, CAST(sum(crit) AS BIGINT) AS n_crit, CAST(sum(high) AS BIGINT) AS n_high, CAST(sum(med) AS BIGINT) AS n_med FROM graded")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summary(grading.graded(spark, sf_dir))


@query("WITH " + grading.graded_sql("cli") + " SELECT doc, score, grade FROM graded")
def score_grade_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.graded(spark, sf_dir, "cli").select("doc", "score", "grade")


@query(GRADED + " SELECT doc, crit, high, med, score, grade FROM graded")
def score_grade_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.graded(spark, sf_dir).select("doc", "crit", "high", "med", "score", "grade")


BY_RULE = "WITH " + grading.FINDINGS_SQL + ", by_rule AS (SELECT rule, arg_min(level, doc) AS level, count(*) AS n, count(DISTINCT doc) AS n_docs FROM facts GROUP BY rule)"


@query(BY_RULE + " SELECT * FROM by_rule")
def failures_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.failures_by_rule(grading.facts(spark, sf_dir), "doc")


@query(GRADED + " SELECT lang, count(*) AS n_docs, count(DISTINCT supplier) AS n_suppliers, CAST(sum(crit) AS BIGINT) AS n_crit, CAST(sum(high) AS BIGINT) AS n_high, CAST(sum(med) AS BIGINT) AS n_med FROM graded GROUP BY lang")
def per_lang_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.severities_by(grading.graded(spark, sf_dir), "lang", "supplier")


@query(GRADED + " SELECT supplier, CAST(sum(100 * crit + 10 * high + med) AS BIGINT) AS badness, count(*) AS n_docs FROM graded GROUP BY supplier ORDER BY badness DESC, supplier LIMIT 10")
def worst_manufacturers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.worst(grading.graded(spark, sf_dir), "supplier", 10)


@query("WITH " + grading.FINDINGS_SQL + "," + derived.DOCUMENTS_SQL + " SELECT rule, count(*) AS n, count(DISTINCT f.doc) AS n_docs, count(DISTINCT supplier) AS n_suppliers, round(100.0::DOUBLE * count(DISTINCT f.doc) / (SELECT count(*) FROM docs), 6) AS percent FROM facts f JOIN docs d ON d.doc = f.doc GROUP BY rule")
def rule_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    return corpus.rule_frequency(grading.facts(spark, sf_dir), "doc", n, "supplier")


@query(GRADED + " SELECT doc, lang, crit, high, med, score, grade, CASE WHEN grade IN ('A', 'B') THEN 0 ELSE 1 END AS quality_fail FROM graded")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.features(grading.graded(spark, sf_dir)).select("doc", "lang", "crit", "high", "med", "score", "grade", "quality_fail")


COMPONENTS = "WITH " + derived.COMPONENTS_SQL


@query(COMPONENTS + " SELECT doc, pos, cas, status, CASE WHEN status = 'format' THEN cas ELSE body || '-' || two_s || '-' || rightd END AS fixed FROM components")
def cas_validate_and_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir)
    return parts.select("doc", "pos", "cas", chemistry.cas_status(F.col("cas")).alias("status"), chemistry.cas_fixed(F.col("cas")).alias("fixed"))


@query(COMPONENTS + " SELECT doc, cas, count(*) AS n FROM components WHERE status = 'ok' GROUP BY doc, cas HAVING count(*) > 1")
def cas_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir).where(chemistry.cas_status(F.col("cas")) == "ok")
    return parts.groupBy("doc", "cas").agg(F.count("*").alias("n")).where("n > 1")


@query(COMPONENTS + " SELECT doc, round(sum(conc), 6) AS total, count(*) AS n, CAST(max(CASE WHEN conc > 100 THEN 1 ELSE 0 END) AS INTEGER) AS out_of_range FROM components GROUP BY doc")
def concentration_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir)
    out = F.max(((F.col("conc") < 0) | (F.col("conc") > 100)).cast("int")).alias("out_of_range")
    return parts.groupBy("doc").agg(F.round(F.sum("conc"), 6).alias("total"), F.count("*").alias("n"), out)


@query(
    "WITH "
    + derived.COMPONENTS_SQL
    + ", coded AS (SELECT doc, pos, CASE WHEN (doc + pos) % 47 = 0 THEN 'H9' || substr(h_code, 3, 2) ELSE h_code END AS code FROM components)"
    + f" SELECT code, count(*) AS n, CAST(bool_or(list_contains({derived.H_SQL}, code)) AS INTEGER) AS known FROM coded GROUP BY code"
)
def h_code_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir)
    code = F.when((F.col("doc") + F.col("pos")) % 47 == 0, F.concat(F.lit("H9"), F.substring("h_code", 3, 2))).otherwise(F.col("h_code"))
    return parts.groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("known", chemistry.known_h(F.col("code")).cast("int"))


def _rule_counts(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    facts = rules.exploded(grading.validated(spark, sf_dir, names), "doc")
    return facts.groupBy("rule", "level").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))


CONSISTENCY = """
WITH {components}, {documents},
one AS (SELECT d.doc, count(c.doc) AS n FROM docs d LEFT JOIN components c ON c.doc = d.doc GROUP BY d.doc),
found AS (
  SELECT doc, 'S2-GHS-INCOMPLETE' AS rule, 'HIGH' AS level FROM one WHERE n > 0 AND doc % 53 <> 0 AND doc % 5 = 0
  UNION ALL SELECT doc, 'S2-GHS-INCOMPLETE', 'HIGH' FROM one WHERE n > 0 AND doc % 53 <> 0 AND doc % 7 = 0
  UNION ALL SELECT doc, 'S2-GHS-INCOMPLETE', 'HIGH' FROM one WHERE n > 0 AND doc % 53 <> 0 AND doc % 9 = 0
  UNION ALL SELECT c.doc, 'S3-CAS-WITHOUT-NAME', 'HIGH' FROM components c JOIN docs USING (doc) WHERE cas <> '' AND name IS NULL
  UNION ALL SELECT c.doc, 'S3-NAME-WITHOUT-CAS', 'HIGH' FROM components c JOIN docs USING (doc) WHERE cas = '' AND name IS NOT NULL
  UNION ALL SELECT doc, 'S14-UN-INCOMPLETE', 'HIGH' FROM docs WHERE doc % 6 = 0
  UNION ALL SELECT doc, 'S14-UN-INCOMPLETE', 'HIGH' FROM docs WHERE doc % 10 = 0
  UNION ALL SELECT doc, 'S2-DUPLICATE-HCODE', 'MED' FROM (
    SELECT doc, row_number() OVER (PARTITION BY doc, CASE WHEN (doc + pos) % 47 = 0 THEN 'H9' || substr(h_code, 3, 2) ELSE h_code END ORDER BY pos) AS nth
    FROM components JOIN docs USING (doc) WHERE doc % 53 <> 0) WHERE nth > 1
  UNION ALL SELECT doc, 'S9-VALUE-WITHOUT-UNIT', 'MED' FROM docs, (VALUES (1), (2)) WHERE doc % 43 = 0)
SELECT rule, level, count(*) AS n, count(DISTINCT doc) AS n_docs FROM found GROUP BY rule, level
""".format(components=derived.COMPONENTS_SQL, documents=derived.DOCUMENTS_SQL)


@query(CONSISTENCY)
def validator_consistency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["S2-GHS-INCOMPLETE", "S3-CAS-WITHOUT-NAME", "S3-NAME-WITHOUT-CAS", "S14-UN-INCOMPLETE", "S2-DUPLICATE-HCODE", "S9-VALUE-WITHOUT-UNIT"]
    return _rule_counts(spark, sf_dir, names)


STRUCTURE = """
WITH {components}, {documents},
one AS (SELECT d.*, count(c.doc) AS n FROM docs d LEFT JOIN components c ON c.doc = d.doc GROUP BY ALL),
found AS (
  SELECT doc, 'product name' AS what FROM one WHERE doc % 37 <> 0 AND doc % 41 = 0
  UNION ALL SELECT doc, 'supplier' FROM one WHERE doc % 11 = 0
  UNION ALL SELECT doc, 'section 2' FROM one WHERE doc % 53 = 0
  UNION ALL SELECT c.doc, 'unknown H-code' FROM components c JOIN one USING (doc) WHERE (c.doc + pos) % 47 = 0 AND c.doc % 53 <> 0
  UNION ALL SELECT doc, 'composition' FROM one WHERE n = 0
  UNION ALL SELECT c.doc, 'cas format' FROM components c JOIN one USING (doc) WHERE status = 'format'
  UNION ALL SELECT c.doc, 'cas check digit' FROM components c JOIN one USING (doc) WHERE status = 'checkdigit'
  UNION ALL SELECT doc, 'section 10' FROM one WHERE doc % 59 = 0
  UNION ALL SELECT doc, 'stability' FROM one WHERE doc % 59 <> 0 AND doc % 6 = 0
  UNION ALL SELECT doc, 'empty array' FROM one WHERE doc % 13 = 0
  UNION ALL SELECT doc, 'date' FROM one WHERE doc % 29 = 0
  UNION ALL SELECT doc, 'date' FROM one WHERE doc % 31 = 0
  UNION ALL SELECT doc, 'placeholder' FROM one WHERE doc % 37 = 0
  UNION ALL SELECT c.doc, 'concentration' FROM components c JOIN one USING (doc) WHERE conc > 100 AND (c.doc + pos) % 43 <> 0
  UNION ALL SELECT doc, 'no statement' FROM one WHERE n = 0 AND doc % 53 <> 0 AND doc % 9 > 1
  UNION ALL SELECT doc, 'section ' || section FROM one, (VALUES (4, 17), (5, 19), (6, 23), (7, 67), (8, 71), (12, 61), (13, 73), (15, 79), (16, 83)) AS missing(section, skip) WHERE doc % skip = 0
  UNION ALL SELECT doc, 'section 9' FROM one WHERE doc % 43 > 1)
SELECT what, count(*) AS n, count(DISTINCT doc) AS n_docs FROM found GROUP BY what
""".format(components=derived.COMPONENTS_SQL, documents=derived.DOCUMENTS_SQL)


@query(STRUCTURE)
def validator_structural_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = rules.exploded(grading.validated(spark, sf_dir, ["STRUCTURAL"]), "doc")
    marks = {
        "no product name": "product name", "SupplierInformation is missing": "supplier",
        "unknown H-code": "unknown H-code", "CompositionAndConcentration is empty": "composition", "invalid CAS": "cas format", "check digit mismatch": "cas check digit",
        "neither StabilityDescription": "stability", "array is present but empty": "empty array",
        "valid date": "date", "is a placeholder": "placeholder", "outside 0": "concentration", "HazardStatement is empty": "no statement",
    }
    number = F.regexp_extract("message", r"^Section (\d+) \(\w+\): section", 1)
    what = F.when(number != "", F.concat(F.lit("section "), number)).otherwise(F.col("message"))
    for mark, name in marks.items():
        what = F.when(F.contains("message", F.lit(mark)), name).otherwise(what)
    return facts.withColumn("what", what).groupBy("what").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))


from . import attribution_queries, generation_queries, input_queries, product_queries, quality_queries, render_queries, report_queries, response_queries, section_queries, source_queries, structure_queries, text_queries  # noqa: E402, F401  (they register their queries here)

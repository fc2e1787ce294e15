"""Models' answers read as records and as corrections, built over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment, responses
from . import derived
from .queries import query


def _filled(template: str):
    """``template`` with KEY and CUST replaced by the order's and the customer's number."""
    return F.replace(F.replace(F.lit(template), F.lit("KEY"), F.col("o_orderkey").cast("string")), F.lit("CUST"), F.col("o_custkey").cast("string"))


def _answers(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    """(doc, answer): the templates by turns."""
    rows, n = derived.table(spark, sf_dir, "orders"), F.col("o_orderkey") % len(templates)
    answer = F.lit(None).cast("string")
    for i, t in enumerate(templates):
        answer = F.when(n == i, _filled(t)).otherwise(answer)
    return rows.select(F.col("o_orderkey").alias("doc"), answer.alias("answer"))


#: Answers of all kinds: whole, fenced and cut off, with quotes inside, a stray bracket,
#: objects side by side, sections wrapped in lists or bare, fields listed or wrapped, none.
RECORDS = [
    '{"Identification":{"SupplierInformation":{"CompanyName":"Company CUST"}},"StabilityReactivity":{"StabilityDescription":["stable KEY","","cool"]}}',
    '```json\n{"Identification":[{"SupplierInformation":{"CompanyName":"Company CUST"}},{"HazardIdentification":{}}],"StabilityReactivity":{"StabilityDescription":"cut KEY',
    '{"Identification":{"SupplierInformation":{"CompanyName":"the "best" of CUST"}},"StabilityReactivity":"KEY"}',
    '{"Identification":{"SupplierInformation":{"CompanyName":"Company CUST"]}},"ToxicologicalInformation":{"Oral":"KEY"},}',
    '{"Identification":{"SupplierInformation":{"CompanyName":"Company CUST"}},"ToxicologicalInformation":[{"Oral":"KEY"} {"Dermal":"KEY"}]}',
    '{"PhysicalChemicalProperties":[{"Colour":{"AdditionalInfo":{"FullText":["red","KEY"]}},"AdditionalInfo":{"FullText":["a","b"]}}],"Identification":[]}',
    "no record for KEY",
]


@query("""
WITH o AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderkey % 7 AS n FROM orders)
SELECT doc, CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 0 END AS way,
  CASE WHEN n IN (0, 1, 3, 4) THEN 'Company ' || c WHEN n = 2 THEN 'the "best" of ' || c END AS company,
  CASE n WHEN 0 THEN 'stable ' || doc || chr(10) || 'cool' WHEN 1 THEN 'cut ' || doc END AS stability,
  CASE n WHEN 3 THEN 1 WHEN 4 THEN 2 END AS n_toxicological,
  CASE WHEN n = 5 THEN 'red' || chr(10) || doc END AS colour, CASE WHEN n = 5 THEN 'b' END AS second_text,
  CASE n WHEN 2 THEN 'StabilityReactivity' WHEN 5 THEN 'Identification' ELSE '' END AS skipped, n = 6 AS malformed
FROM o""")
def answered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.answered_records(_answers(spark, sf_dir, RECORDS))
    properties = lambda path: F.get_json_object("PhysicalChemicalProperties", path)
    toxic = F.col("ToxicologicalInformation")
    return found.select(
        "doc", "way", F.col("Identification.SupplierInformation.CompanyName").alias("company"), F.col("StabilityReactivity.StabilityDescription").alias("stability"),
        F.when(toxic.isNotNull(), F.size(toxic)).alias("n_toxicological"), properties("$.Colour").alias("colour"), properties("$.AdditionalInfo.FullText[1]").alias("second_text"),
        F.array_join("skipped", ",").alias("skipped"), "malformed",
    )


#: Lists of corrections: fenced with words around, a deletion, an empty list, wrong ones.
CORRECTIONS = [
    'Here: [{"original":"H999","corrected":"H225","reason":"order CUST"},{"original":"H998","corrected":null}] as asked',
    '```json\n[{"original":"H999","corrected":"H9CUST"}, {"original":"H998","corrected":"H302","reason":null}]\n```\n[not this]',
    "[]", '[{"original":KEY,"corrected":"H225"}]', "no list", '[{"original":"H999","corrected":"H301"', '[{"original":"H999"} {"original":"H998"}]',
]


@query("""
WITH o AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderkey % 7 AS n FROM orders)
SELECT doc, 0 AS pos, 'H999' AS code, 'H225' AS corrected, 'order ' || c AS reason, NULL AS error FROM o WHERE n = 0
UNION ALL SELECT doc, 1, 'H998', NULL, NULL, NULL FROM o WHERE n = 0
UNION ALL SELECT doc, 0, 'H999', 'H9' || c, NULL, NULL FROM o WHERE n = 1
UNION ALL SELECT doc, 1, 'H998', 'H302', NULL, NULL FROM o WHERE n = 1
UNION ALL SELECT doc, 0, NULL, NULL, NULL, CASE n WHEN 3 THEN 'no corrections' WHEN 6 THEN 'no JSON' ELSE 'no list' END FROM o WHERE n >= 3""")
def correction_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.corrections(_answers(spark, sf_dir, CORRECTIONS))


@query("""
WITH o AS (SELECT o_orderkey AS doc, o_orderkey % 7 AS n FROM orders), codes AS (SELECT doc, n, unnest(['H999', 'H998', 'H225']) AS code FROM o), a AS (
  SELECT code, CASE WHEN n = 0 AND code = 'H998' THEN 'delete' WHEN n = 0 OR (n = 1 AND code = 'H998') THEN 'replace' ELSE 'keep' END AS action,
    CASE WHEN n = 0 AND code = 'H998' THEN NULL WHEN n = 0 THEN 'H225' WHEN n = 1 AND code = 'H998' THEN 'H302' ELSE code END AS corrected FROM codes WHERE code <> 'H225')
SELECT code, action, corrected, count(*) AS n FROM a GROUP BY ALL""")
def correction_answers_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir, CORRECTIONS)
    codes = answers.select("doc", F.posexplode(F.array(F.lit("H999"), F.lit("H998"), F.lit("H225"))).alias("pos", "code"))
    found = responses.corrections(answers).where("error is null")
    return enrichment.corrected_codes(codes, found).groupBy("code", "action", "corrected").agg(F.count("*").alias("n"))

"""Checks of records against their source texts and their countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compliance, source_check
from . import derived
from .queries import query


def _plain(x: str) -> str:
    return f"translate(regexp_replace({x}, '\\s+', '', 'g'), '{text.SEARCH_FROM}', '{text.SEARCH_TO}')"


VERIFY_SQL = rf"""
WITH v AS (
  SELECT doc_id, 'TradeNameJP' AS field, 'product' AS kind, 1 AS section, CASE doc_id % 4 WHEN 0 THEN replace(trim(substr(text, 3, 24)), ' ', '  ') WHEN 1 THEN 'never said ' || doc_id WHEN 2 THEN 'アセトン' || doc_id ELSE 'N/A' END AS value, false AS corrected FROM documents
  UNION ALL SELECT doc_id, 'CASno', 'cas', 3, CASE doc_id % 3 WHEN 0 THEN '64-17-5' WHEN 1 THEN '64-17-6' ELSE substr(text, 1, 9) END, doc_id % 7 = 0 FROM documents
  UNION ALL SELECT doc_id, 'IupacName', 'substance', 3, CASE doc_id % 4 WHEN 0 THEN '1,2-' || trim(substr(text, 3, 24)) WHEN 1 THEN 'ab' WHEN 2 THEN trim(substr(text, 1, 22)) || '(in a form that no text of this table goes on with)' ELSE 'メタノール' END, false FROM documents
  UNION ALL SELECT doc_id, 'CompanyName', 'company', 1, CASE doc_id % 2 WHEN 0 THEN 'カイシャ' ELSE 'never said either' END, false FROM documents),
s AS (SELECT v.*, d.text, {_plain('d.text')} AS plain, {_plain('v.value')} AS short, trim(left(v.value, greatest(CASE WHEN strpos(left(v.value, 35), '(') > 0 THEN strpos(left(v.value, 35), '(') - 1 ELSE 25 END, 8))) AS base FROM v JOIN documents d USING (doc_id)),
f AS (SELECT *, contains(text, trim(value)) OR contains(plain, short) OR (length(value) > 40 AND (contains(text, base) OR contains(plain, {_plain('base')})))
    OR (strlen(regexp_replace(short, '^[0-9,-]+', '')) >= 8 AND contains(plain, regexp_replace(short, '^[0-9,-]+', ''))) AS found, regexp_matches(text, '[\x{{3040}}-\x{{30FF}}]') AS kana FROM s)
SELECT doc_id, section, field, value, 'not_found' AS problem FROM f WHERE text IS NOT NULL AND NOT found AND ((kind IN ('product', 'substance') AND strlen(trim(value)) >= 3 AND value <> 'N/A') OR (kind = 'cas' AND value = '64-17-5' AND NOT corrected))
UNION ALL SELECT doc_id, section, field, value, 'foreign_script' FROM f WHERE kind <> 'cas' AND NOT kana AND regexp_matches(value, '[\x{{3040}}-\x{{30FF}}]')"""


@query(VERIFY_SQL)
def source_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values made from whole documents and others, against the documents."""
    docs, n = derived.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    said = F.concat(F.lit("never said "), n.cast("string"))
    some = F.trim(F.substring("text", 3, 24))
    long = F.concat(F.trim(F.substring("text", 1, 22)), F.lit("(in a form that no text of this table goes on with)"))
    values = {
        "TradeNameJP": F.when(n % 4 == 0, F.replace(some, F.lit(" "), F.lit("  "))).when(n % 4 == 1, said).when(n % 4 == 2, F.concat(F.lit("アセトン"), n.cast("string"))).otherwise("N/A"),
        "CASno": F.when(n % 3 == 0, "64-17-5").when(n % 3 == 1, "64-17-6").otherwise(F.substring("text", 1, 9)),
        "IupacName": F.when(n % 4 == 0, F.concat(F.lit("1,2-"), some)).when(n % 4 == 1, "ab").when(n % 4 == 2, long).otherwise("メタノール"),
        "CompanyName": F.when(n % 2 == 0, "カイシャ").otherwise("never said either"),
    }
    made = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(0).alias("pos"), v.alias("value"), ((n % 7 == 0) & F.lit(k == "CASno")).alias("corrected")) for k, v in values.items()))
    rows = docs.select("doc_id", F.explode(made).alias("v")).select("doc_id", "v.*")
    return source_check.unverified(rows, docs.withColumnRenamed("text", "source"), "doc_id").select("doc_id", "section", "field", "value", "problem")


@query("""
WITH r AS (SELECT o_orderkey AS doc, ['cn', 'kr', 'tw', 'jp'][1 + o_custkey % 4] AS country, o_orderkey % 3 AS phone, o_orderkey % 11 AS reg FROM orders)
SELECT doc, country, 1 AS section, 'no_emergency_contact' AS warning FROM r WHERE country <> 'jp' AND phone = 0
UNION ALL SELECT doc, country, 15, 'no_catalogue_reference' FROM r WHERE country = 'cn' AND reg < 3""")
def country_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, reg = F.col("o_orderkey"), F.col("o_orderkey") % 11
    country = F.element_at(F.array(*map(F.lit, ("cn", "kr", "tw", "jp"))), (F.col("o_custkey") % 4).cast("int") + 1)
    rows = derived.table(spark, sf_dir, "orders").select(
        key.alias("doc"), country.alias("country"), F.when(key % 3 == 1, "119").when(key % 3 == 2, " ").alias("emergency_phone"),
        F.when(reg == 1, "GB 1369").when(reg == 2, "GB-30000").when(reg == 3, "GB13690").when(reg == 4, "as GB 30000.7").when(reg > 4, "危险化学品目录").alias("regulatory"),
    )
    return compliance.warnings(rows, "doc")

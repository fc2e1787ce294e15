"""Quality checks over derived hazard labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import quality, rules
from . import derived
from .queries import query

SIGNALS = ["Danger", "Warning", "N/A", "危険、警告", "Beware", "", "危険", "ダメ"]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, lang, signal, h_codes, p_codes, statements, pictograms, classification)."""
    parts = derived.components(spark, sf_dir)
    key, pos = F.col("doc"), F.col("pos")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values)).cast("int") + 1)
    h = F.when(key % 10 != 3, F.col("h_code"))
    p = F.when(key % 12 != 5, pick(chemistry.P_CODES, key * 17 + pos * 29))
    per_doc = parts.groupBy("doc").agg(F.collect_set(h).alias("h_codes"), F.collect_set(p).alias("p_codes"), F.collect_list(F.coalesce(h, F.lit(""))).alias("statements"))
    per_doc = per_doc.withColumn("statements", F.when(key % 14 == 6, F.array().cast("array<string>")).otherwise(F.col("statements")))
    docs = derived.documents(spark, sf_dir).select("doc", "lang").join(per_doc, "doc")
    pictograms = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 11 == 0, F.array(F.lit("flame"), F.lit("GHS07"))).otherwise(F.array(F.concat(F.lit("GHS0"), (key % 9 + 1).cast("string"))))
    return docs.withColumns({"signal": pick(SIGNALS, key), "pictograms": pictograms, "classification": F.when(key % 9 != 0, "some")})


def _sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rules_sql() -> str:
    danger, warning, active, severe = (_sql(x) for x in (quality.DANGER, quality.WARNING, quality.ACTIVE_SIGNALS, quality.SEVERE_CODES))
    valid, english = (_sql([v.lower() for v in x]) for x in (quality.VALID_SIGNALS, quality.ENGLISH_SIGNALS))
    is_in = lambda x: f"list_contains({x}, signal)"
    has = lambda h: f"list_has_any(h, {_sql(h)})"
    bad = f"signal <> '' AND NOT list_contains({valid}, lower(signal))"
    rows = [
        ("S2-MULTIPLE-SIGNAL-WORDS", "HIGH", f"{bad} AND signal = '危険、警告'"), ("S2-INVALID-SIGNAL-WORD", "MED", f"{bad} AND signal <> '危険、警告'"),
        ("S2-KATAKANA-SIGNAL-WORD", "HIGH", "lang IN ('zh-cn', 'zh-tw') AND signal = 'ダメ'"), ("S2-NON-ENGLISH-SIGNAL-WORD", "MED", f"signal <> '' AND lang = 'en' AND NOT list_contains({english}, lower(signal))"),
        ("S2-H224-NO-DANGER", "HIGH", f"signal <> '' AND {has(['H224'])} AND NOT {is_in(danger)}"), ("S2-H226-ALONE-DANGER", "MED", f"{is_in(danger)} AND {has(['H226'])} AND NOT list_has_any(h, {severe})"),
        ("S2-HS-CODES-EMPTY", "CRIT", f"len(h) = 0 AND {is_in(active)} AND doc % 14 <> 6"), ("S2-SIGNAL-NO-HAZARDSTATEMENT", "HIGH", f"{is_in(active)} AND doc % 14 = 6"), ("S2-SIGNAL-NO-HCODES", "HIGH", f"{is_in(active)} AND len(h) = 0"),
        ("S2-TOO-MANY-HCODES", "MED", "len(h) > 12"), ("S2-DANGER-NO-CAT12", "MED", f"{is_in(danger)} AND len(h) > 0 AND NOT list_has_any(h, {severe})"),
        ("S2-NO-PCODES", "HIGH", "signal <> '' AND len(h) > 0 AND len(p) = 0"), ("S2-DANGER-FEW-PCODES", "MED", f"{is_in(danger)} AND len(p) BETWEEN 1 AND 3"), ("S2-WARNING-FEW-PCODES", "MED", f"{is_in(warning)} AND len(p) BETWEEN 1 AND 2"),
        *((name, "MED", f"{has(h)} AND NOT list_has_any(p, {_sql(p)})") for name, h, p in quality.NEEDS_ANY),
        ("S2-H314-MISSING-P", "MED", f"{has(['H314'])} AND NOT list_has_all(p, {_sql(quality.CORROSIVE_NEEDS)})"), ("S2-INVALID-PICTOGRAM", "MED", "doc % 5 <> 0 AND doc % 11 = 0"),
        ("S2-NO-CLASSIFICATION", "MED", "len(h) > 0 AND doc % 9 = 0"), ("S2-HAZARD-NO-PICTOGRAM", "MED", f"{is_in(active)} AND len(h) > 0 AND doc % 5 = 0"),
        *((name, "MED", f"doc % 5 <> 0 AND {has(h)} AND NOT contains(pics, '{g}')") for name, g, h in quality.NEEDS_PICTOGRAM),
    ]
    found = " UNION ALL ".join(f"SELECT doc, '{name}' AS rule, '{level}' AS level FROM label WHERE {when}" for name, level, when in rows)
    p_list = _sql(chemistry.P_CODES)
    return f"""
WITH {derived.COMPONENTS_SQL}, {derived.DOCUMENTS_SQL},
per_doc AS (
  SELECT doc, coalesce(list_distinct(list(CASE WHEN doc % 10 <> 3 THEN h_code END)), []) AS h,
    coalesce(list_distinct(list(CASE WHEN doc % 12 <> 5 THEN {p_list}[1 + (doc * 17 + pos * 29) % {len(chemistry.P_CODES)}] END)), []) AS p FROM components GROUP BY doc),
label AS (
  SELECT d.doc, d.lang, h, p, {_sql(SIGNALS)}[1 + d.doc % {len(SIGNALS)}] AS signal, CASE WHEN d.doc % 11 = 0 THEN 'flame GHS07' ELSE 'GHS0' || (d.doc % 9 + 1) END AS pics FROM docs d JOIN per_doc USING (doc)),
found AS ({found})
SELECT rule, level, count(*) AS n, count(DISTINCT doc) AS n_docs FROM found GROUP BY rule, level"""


@query(_rules_sql())
def quality_section2(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = rules.exploded(quality.checked(labels(spark, sf_dir)), "doc")
    return facts.groupBy("rule", "level").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))

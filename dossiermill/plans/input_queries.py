"""Formulation checks over derived components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import product_input, rules
from . import derived
from .queries import query

INPUT_SQL = f"""
WITH {derived.COMPONENTS_SQL},
i AS (
  SELECT doc, pos, cas, status, CASE WHEN (doc + pos) % 4 <> 0 THEN conc END AS exact, CASE WHEN (doc + pos) % 4 IN (0, 1) THEN conc - 5 END AS lower_, CASE WHEN (doc + pos) % 4 = 0 THEN conc - (doc % 3) * 5 END AS upper_,
    CASE WHEN (doc + pos) % 43 = 0 THEN ' ' ELSE '%' END AS unit, row_number() OVER (PARTITION BY doc, cas ORDER BY pos) AS nth FROM components),
found AS (
  SELECT doc, 'GEN-CAS-DUPLICATE' AS rule, 'MED' AS level FROM i WHERE status = 'ok' AND nth > 1
  UNION ALL SELECT doc, 'GEN-CAS-FORMAT', 'HIGH' FROM i WHERE status = 'format'
  UNION ALL SELECT doc, 'GEN-CAS-CHECKDIGIT', 'HIGH' FROM i WHERE status = 'checkdigit'
  UNION ALL SELECT doc, 'GEN-CONC-NO-UNIT', 'MED' FROM i WHERE trim(unit) = ''
  UNION ALL SELECT doc, 'GEN-CONC-AMBIGUOUS', 'MED' FROM i WHERE exact IS NOT NULL AND (lower_ IS NOT NULL OR upper_ IS NOT NULL)
  UNION ALL SELECT doc, 'GEN-CONC-RANGE-INVALID', 'HIGH' FROM i WHERE lower_ > upper_
  UNION ALL SELECT doc, 'GEN-CONC-SUM-EXCEEDS-100', 'MED' FROM i GROUP BY doc HAVING round(sum(exact), 6) > 102)
SELECT rule, level, count(*) AS n, count(DISTINCT doc) AS n_docs FROM found GROUP BY rule, level"""


@query(INPUT_SQL)
def product_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir)
    n = (F.col("doc") + F.col("pos")) % 4
    rows = parts.select(
        F.col("doc").alias("product"), "pos", "cas", "name", F.when(n != 0, F.col("conc")).alias("exact"), F.when(n.isin(0, 1), F.col("conc") - 5).alias("lower"),
        F.when(n == 0, F.col("conc") - (F.col("doc") % 3) * 5).alias("upper"), F.when((F.col("doc") + F.col("pos")) % 43 == 0, " ").otherwise("%").alias("unit"),
    )
    facts = rules.exploded(product_input.checked_inputs(rows), "product")
    return facts.groupBy("rule", "level").agg(F.count("*").alias("n"), F.count_distinct("product").alias("n_docs"))

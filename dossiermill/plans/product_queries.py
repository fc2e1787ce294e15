"""Queries on products: evidence resolution, identities, corrections, compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import compliance, enrichment, resolution
from . import derived, grading
from .queries import query

PROPERTIES = list(resolution.POLICIES)
LEVELS = list(resolution.BUCKETS)
APPLIES = ["finished_product", "same_batch", "equivalent_batch", "finished_product", "component", "unknown"]


def _sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, entries, sources) over the order tables: a line item is a measurement
    and, by its number, an evidence source of the same order."""
    li = derived.table(spark, sf_dir, "lineitem")
    order, line, part, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values)).cast("int") + 1)
    pos = line.cast("long") * 10_000_000_000 + part * 10_000 + supp % 10_000  # line numbers repeat within an order
    entries = li.select(
        order.alias("product"), pick(PROPERTIES, order + F.floor(line / 3)).alias("property"), pos.alias("pos"), (F.col("l_quantity").cast("int") % 3).alias("value"),
        F.concat(F.lit("E"), (line + F.when(part % 10 == 0, 50).otherwise(0)).cast("string")).alias("evidence_id"),
        F.when(part % 7 != 0, "closed cup").alias("method"), F.when(part % 9 != 0, F.lit(20.0)).alias("temperature"),
    )
    level = F.when(supp % 3 != 0, "product_test_report").otherwise(pick(LEVELS, supp))
    sources = li.select(order.alias("product"), F.concat(F.lit("E"), line.cast("string")).alias("id"), pos.alias("pos"), level.alias("level"), pick(APPLIES, part).alias("applies_to"))
    products = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("product"))
    return products, entries, sources


POS_SQL = "l_linenumber::BIGINT * 10000000000 + l_partkey * 10000 + l_suppkey % 10000"
RESOLVED_SQL = f"""
WITH e AS (
  SELECT l_orderkey AS product, {_sql(PROPERTIES)}[CAST(1 + (l_orderkey + l_linenumber // 3) % 7 AS BIGINT)] AS property, {POS_SQL} AS pos, CAST(trunc(l_quantity) AS INTEGER) % 3 AS value,
    CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_linenumber END AS eid, CASE WHEN l_partkey % 7 <> 0 THEN 'closed cup' END AS method, CASE WHEN l_partkey % 9 <> 0 THEN 20.0 END AS temperature FROM lineitem),
every_source AS (
  SELECT l_orderkey AS product, l_linenumber AS eid, {POS_SQL} AS pos, CASE WHEN l_suppkey % 3 <> 0 THEN 'product_test_report' ELSE {_sql(LEVELS)}[1 + l_suppkey % {len(LEVELS)}] END AS level, {_sql(APPLIES)}[1 + l_partkey % 6] AS applies_to FROM lineitem),
s AS (SELECT product, eid, arg_min(level, pos) AS level, arg_min(applies_to, pos) AS applies_to FROM every_source GROUP BY product, eid),
checked AS (
  SELECT e.*, s.level, CASE WHEN s.eid IS NULL THEN 'missing_input' WHEN applies_to = 'component' THEN 'mixture_cannot_be_derived_from_components' WHEN applies_to IN ('reference_substance', 'unknown') THEN 'product_test_required'
    WHEN NOT (level IN ('product_test_report', 'equivalent_batch_test_report') OR (property = 'FlashPoint' AND level = 'supplier_specification')) THEN 'product_test_required' END AS reason
  FROM e LEFT JOIN s ON s.product = e.product AND s.eid = e.eid),
grouped AS (
  SELECT product, property, arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL) AS first_reason, count(DISTINCT value) FILTER (WHERE reason IS NULL) AS n_values, count(*) FILTER (WHERE reason IS NULL) AS eligible,
    arg_min(struct_pack(value := value, method := method, temperature := temperature, level := level), pos) FILTER (WHERE reason IS NULL) AS best FROM checked GROUP BY product, property),
every AS (SELECT o_orderkey AS product, unnest({_sql(PROPERTIES)}) AS property FROM orders),
judged AS (
  SELECT v.product, v.property, g.best, CASE WHEN g.product IS NULL THEN 'human_review_required' WHEN eligible = 0 THEN first_reason WHEN n_values > 1 THEN 'conflicting_sources'
    WHEN best.method IS NULL OR (v.property = 'VapourPressure' AND best.temperature IS NULL) THEN 'insufficient_measurement_conditions' END AS reason
  FROM every v LEFT JOIN grouped g ON g.product = v.product AND g.property = v.property),
resolved AS (SELECT product, property, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'unresolved' END AS status, reason, CASE WHEN reason IS NULL THEN best.value END AS value, CASE WHEN reason IS NULL THEN best.level END AS level FROM judged)"""


@query(RESOLVED_SQL + " SELECT * FROM resolved")
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolved(*evidence(spark, sf_dir))


@query(RESOLVED_SQL + " SELECT product, count(*) FILTER (WHERE status = 'unresolved') AS unresolved, " + ", ".join(
    f"count(*) FILTER (WHERE level IN ({', '.join(repr(k) for k, b in resolution.BUCKETS.items() if b == bucket)})) AS {bucket}" for bucket in dict.fromkeys(resolution.BUCKETS.values())
) + ", count(*) FILTER (WHERE level IN ('product_test_report', 'equivalent_batch_test_report')) AS product_test_evidence FROM resolved GROUP BY product")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.evidence_summary(resolution.resolved(*evidence(spark, sf_dir)))


@query(RESOLVED_SQL + "," + grading.FINDINGS_SQL.removeprefix("\n") + """, o AS (SELECT product, bool_or(coalesce(reason = 'conflicting_sources', false)) AS blocked, count(*) FILTER (WHERE status = 'unresolved') AS n FROM resolved GROUP BY product),
f AS (SELECT doc, bool_or(level IN ('CRIT', 'HIGH')) AS severe, count(*) AS n FROM facts GROUP BY doc)
SELECT o.product, CASE WHEN blocked OR coalesce(severe, false) THEN 'blocked' WHEN o.n > 0 OR coalesce(f.n, 0) > 0 THEN 'review_required' ELSE 'draft' END AS status FROM o LEFT JOIN f ON f.doc = o.product""")
def release_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = grading.facts(spark, sf_dir).select(F.col("doc").alias("product"), "level")
    return resolution.release_status(resolution.resolved(*evidence(spark, sf_dir)), findings)


@query(RESOLVED_SQL + f" SELECT product, string_agg('resolve ' || property, '; ' ORDER BY list_position({_sql(PROPERTIES)}, property)) AS actions FROM resolved WHERE reason = 'conflicting_sources' GROUP BY product")
def release_gate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.required_actions(resolution.resolved(*evidence(spark, sf_dir)))


COMPONENTS = "WITH " + derived.COMPONENTS_SQL


@query(COMPONENTS + ", k AS (SELECT cas, CASE WHEN pos % 5 = 0 THEN NULL ELSE CAST(pos AS BIGINT) % 2 END AS cid FROM components WHERE status = 'ok'), n AS (SELECT cas, count(DISTINCT cid) AS n_candidates FROM k GROUP BY cas) SELECT cas, n_candidates, CASE n_candidates WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM n")
def cas_resolution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir).where(chemistry.cas_status(F.col("cas")) == "ok")
    return enrichment.resolution_status(parts.select("cas", F.when(F.col("pos") % 5 != 0, F.col("pos").cast("long") % 2).alias("cid")))


@query(COMPONENTS + """, ok AS (SELECT * FROM components WHERE status = 'ok'),
resolver AS (SELECT cas, CASE WHEN body % 3 = 0 THEN 'other thing' ELSE 'Substance ' || (body % 997) END AS known FROM ok WHERE body % 4 <> 0 GROUP BY ALL),
j AS (SELECT o.doc, o.pos, o.cas, r.known, o.name, CASE WHEN lower(r.known) = lower(o.name) THEN 1.0 WHEN split_part(lower(r.known), ' ', 1) = 'substance' THEN 1 / 3.0 ELSE 0.0 END AS near FROM ok o LEFT JOIN resolver r ON r.cas = o.cas)
SELECT doc, pos, cas, CASE WHEN known IS NULL THEN 'not_found' ELSE 'name_mismatch' END AS warning FROM j WHERE known IS NULL OR (name IS NOT NULL AND near < 0.5)""")
def enrichment_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir)
    ok = parts.where(chemistry.cas_status(F.col("cas")) == "ok")
    body = F.split("cas", "-")[0].cast("long")
    name = F.when(body % 3 == 0, "other thing").otherwise(F.concat(F.lit("Substance "), (body % 997).cast("string")))
    resolver = ok.where(body % 4 != 0).select("cas", name.alias("name")).distinct()
    return enrichment.identity_warnings(parts, resolver)


@query(COMPONENTS + """, coded AS (SELECT doc, pos, 'H9' || substr(h_code, 3, 2) AS code, doc % 4 AS kind FROM components WHERE pos % 3 = 0)
SELECT doc, pos, code, CASE kind WHEN 0 THEN 'replace' WHEN 1 THEN 'delete' ELSE 'keep' END AS action, CASE kind WHEN 0 THEN 'H315' WHEN 1 THEN NULL ELSE code END AS corrected FROM coded""")
def correction_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.components(spark, sf_dir)
    codes = parts.select("doc", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("H9"), F.substring("h_code", 3, 2))).otherwise(F.col("h_code")).alias("code"))
    kind = F.col("doc") % 4
    wrong = codes.where("pos % 3 = 0 and doc % 4 < 3")
    old = wrong.select("doc", "code", F.lit("H200").alias("corrected"), (F.col("pos") - 10).alias("pos"))
    new = wrong.select("doc", "code", F.when(kind == 0, "h315").when(kind == 2, "H000").alias("corrected"), "pos")
    return enrichment.corrected_codes(codes, old.unionByName(new))


@query("""
SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'a1' WHEN o_orderkey % 3 = 0 THEN 'b1' END AS s1, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'a2' WHEN o_orderkey % 3 = 0 THEN 'b2' END AS s2
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc")
    docs = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    a = docs.where("doc % 2 = 0").select("doc", F.lit("a1").alias("s1"), F.when(key % 5 == 0, "a2").alias("s2"))
    b = docs.where("doc % 3 = 0").select("doc", F.lit("b1").alias("s1"), F.lit("b2").alias("s2"))
    return enrichment.merged_sections(a, b, "doc", ["s1", "s2"])


@query("""
WITH r AS (
  SELECT o_orderkey AS doc, ['cn', 'kr', 'tw', 'jp'][1 + o_custkey % 4] AS country, o_orderkey % 3 <> 0 AS emergency, o_orderkey % 5 <> 0 AS exposure, o_orderkey % 7 <> 0 AS tox, o_orderkey % 11 AS reg FROM orders),
g AS (
  SELECT doc, country, 1 AS section, 'EmergencyContact' AS field, CASE country WHEN 'tw' THEN 'Major' ELSE 'Critical' END AS severity FROM r WHERE country <> 'jp' AND NOT emergency
  UNION ALL SELECT doc, country, 8, 'OccupationalExposureLimits', 'Major' FROM r WHERE country = 'cn' AND NOT exposure
  UNION ALL SELECT doc, country, 11, 'AcuteToxicity', 'Major' FROM r WHERE country = 'cn' AND NOT tox
  UNION ALL SELECT doc, country, 15, 'RegulatoryInformation', CASE country WHEN 'cn' THEN 'Critical' WHEN 'kr' THEN 'Major' ELSE 'Advisory' END FROM r WHERE country <> 'jp' AND reg < 3
  UNION ALL SELECT doc, country, 15, 'RegulatoryInformation', 'Advisory' FROM r WHERE country = 'jp' AND reg = 0)
SELECT * FROM g""")
def compliance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    country = F.element_at(F.array(*map(F.lit, ("cn", "kr", "tw", "jp"))), (F.col("o_custkey") % 4).cast("int") + 1)
    law = F.lit(None).cast("string")
    for name, words in (("cn", "危险化学品安全管理条例"), ("kr", "산업안전보건법"), ("tw", "職業安全衛生法"), ("jp", "x")):
        law = F.when(F.col("country") == name, words).otherwise(law)
    rows = derived.table(spark, sf_dir, "orders").select(
        key.alias("doc"), country.alias("country"), F.when(key % 3 != 0, "119").otherwise(" ").alias("emergency_phone"), F.when(key % 5 != 0, "GBZ 2.1").alias("exposure"),
        F.when(key % 7 != 0, "oral").alias("acute_toxicity"), (key % 11).alias("reg"),
    )
    rows = rows.withColumn("regulatory", F.when(F.col("reg") == 0, None).when(F.col("reg") < 3, "general remarks").otherwise(law))
    return compliance.gaps(rows, "doc")

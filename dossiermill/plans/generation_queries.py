"""Drafts of records, the provenance of their fields and what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generation, identities, resolution
from . import derived
from .product_queries import RESOLVED_SQL, evidence
from .queries import query
from .report_queries import looked_up


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, components, identities) over the order tables."""
    key = F.col("o_orderkey")
    text = lambda name: F.concat(F.lit(f"{name} "), key.cast("string"))
    products = derived.table(spark, sf_dir, "orders").select(
        key.alias("product"), text("Product").alias("trade_name"), F.when(key % 3 == 0, F.array(text("alias"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("other_names"),
        F.concat(F.lit("M"), (F.col("o_custkey") % 53).cast("string")).alias("company_name"), F.when(key % 4 != 0, text("street")).alias("address"), F.when(key % 5 != 0, text("+1")).alias("phone"), F.when(key % 7 != 0, "a@example.com").alias("email"),
    )
    ranged = F.col("pos") % 2 == 1
    components = derived.components(spark, sf_dir).select(
        F.col("doc").alias("product"), "pos", "name", F.nullif("cas", F.lit("")).alias("cas"), F.when(~ranged, F.col("conc")).alias("exact"), F.when(ranged, F.col("conc") / 2).alias("lower"), F.when(ranged, F.col("conc")).alias("upper"),
        F.when(F.col("pos") % 3 == 0, " ").otherwise("%").alias("unit"),
    )
    _, candidates, errors = looked_up(spark, sf_dir)
    k = F.substring("cas", 1, 5).cast("int")
    normalized = F.col("structure") == "normalized"
    known = identities.outcomes(candidates, errors).select(
        "cas", "outcome", F.when(k % 3 > 0, F.concat(F.lit("iupac "), k.cast("string"))).alias("iupac_name"), "formula", k.alias("cid"),
        (normalized & (F.col("formula") != F.col("calculated"))).alias("mismatch"), F.when(normalized, "CCO").alias("source_smiles"), (k % 6 == 0).alias("fallback"),
    )
    return products, components, known


PARTS_SQL = f"""{derived.COMPONENTS_SQL},
c AS (
  SELECT doc AS product, pos, nullif(cas, '') AS cas, name, body AS k, status = 'ok' AS valid, CASE WHEN pos % 2 = 0 THEN conc END AS exact, CASE WHEN pos % 2 = 1 THEN conc / 2 END AS lower_, CASE WHEN pos % 2 = 1 THEN conc END AS upper_, CASE WHEN pos % 3 = 0 THEN ' ' ELSE '%' END AS unit,
    CASE WHEN cas = '' THEN NULL WHEN body % 8 = 0 THEN 'error' WHEN body % 4 IN (1, 2) THEN 'resolved' WHEN body % 4 = 3 THEN 'ambiguous' END AS outcome FROM components),
p AS (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY pos, cas NULLS FIRST, name NULLS FIRST, exact NULLS FIRST, lower_ NULLS FIRST, upper_ NULLS FIRST) - 1 AS i, coalesce(outcome = 'resolved', false) AS known,
    k % 5 > 1 AS normal, k % 5 > 1 AND k % 3 = 0 AND k % 7 <> 0 AS mismatch FROM c)"""
AT = "'Composition.CompositionAndConcentration[' || i || '].{}'"
NUMBER = "list_position([" + ", ".join(f"'{p}'" for p in resolution.POLICIES) + "], property)"
PATH = "CASE property " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in generation.PROPERTY_PATHS.items()) + " END"


@query("WITH " + PARTS_SQL + """,
rows AS (
  SELECT product, '[' || string_agg('{' || CASE WHEN name IS NULL AND cas IS NULL THEN '' ELSE '"SubstanceIdentifiers":{"SubstanceNames":{' || concat_ws(',', CASE WHEN known AND k % 3 > 0 THEN '"IupacName":"iupac ' || k || '"' END, '"GenericName":"' || name || '"') || '}'
    || CASE WHEN cas IS NULL THEN '' ELSE ',"SubstanceIdentity":{"CASno":{"FullText":["' || cas || '"]}}' END || '},' END || CASE WHEN known AND NOT mismatch THEN '"MolecularFormula":"C2H6O",' ELSE '' END
    || '"Concentration":{"NumericRangeWithUnitAndQualifier":{' || concat_ws(',', '"ExactValue":{"Value":' || exact || '}', '"LowerValue":{"Value":' || lower_ || '}', '"UpperValue":{"Value":' || upper_ || '}', CASE WHEN unit = '%' THEN '"Unit":"%"' END) || '}}}', ',' ORDER BY i) || ']' AS list FROM p GROUP BY product)
SELECT o_orderkey AS product, '{"Identification":{"TradeProductIdentity":{"TradeNameJP":"Product ' || o_orderkey || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"OtherName":["alias ' || o_orderkey || '","other"]' ELSE '' END
  || '},"SupplierInformation":{' || concat_ws(',', '"CompanyName":"M' || (o_custkey % 53) || '"', CASE WHEN o_orderkey % 4 <> 0 THEN '"Address":"street ' || o_orderkey || '"' END, CASE WHEN o_orderkey % 5 <> 0 THEN '"Phone":"+1 ' || o_orderkey || '"' END, CASE WHEN o_orderkey % 7 <> 0 THEN '"Email":"a@example.com"' END) || '}}'
  || CASE WHEN list IS NULL THEN '' ELSE ',"Composition":{"CompositionAndConcentration":' || list || '}' END || '}' AS record
FROM orders LEFT JOIN rows ON product = o_orderkey""")  # fmt: skip
def generation_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generation.drafts(*inputs(spark, sf_dir))
    return found.select("product", F.to_json(F.struct("Identification", "Composition")).alias("record"))


def _entry_sql(part: int, place: str, k: int, path: str, source: str, reference: str, method: str, confidence: str, table: str, when: str = "true") -> str:
    return f"SELECT product, {part} AS part, {place} AS place, {k} AS k, {path} AS path, {source} AS source_type, {reference} AS source_reference, {method} AS method, '{confidence}' AS confidence, {'k % 6 = 0' if part == 3 else 'false'} AS warned FROM {table} WHERE {when}"


def _provenance_sql() -> str:
    user = ("'unverified_user_input'", "NULL")
    given = {"trade_name": "true", "other_names": "product % 3 = 0", "company_name": "true", "address": "product % 4 <> 0", "phone": "product % 5 <> 0", "email": "product % 7 <> 0"}
    rows = [_entry_sql(0, "0", n, f"'{generation.PRODUCT_FIELDS[c]}'", *user, "'supplied in ProductInput'", "unverified", "(SELECT o_orderkey AS product FROM orders)", when) for n, (c, when) in enumerate(given.items())]
    cid, lookup = ("'reference_database'", "'PubChem CID ' || k"), "'CAS lookup through existing enrichment layer (PubChem)'"
    rows += [
        _entry_sql(1, "i", 0, AT.format(generation.GENERIC_NAME), *user, "'supplied in ComponentInput'", "unverified", "p", "name IS NOT NULL"), _entry_sql(1, "i", 1, AT.format(generation.CAS_NO), *user, "'supplied and check-digit validated'", "unverified", "p", "cas IS NOT NULL"),
        _entry_sql(1, "i", 2, AT.format(generation.IUPAC_NAME), *cid, lookup, "medium", "p", "known AND k % 3 > 0"), _entry_sql(1, "i", 3, AT.format("MolecularFormula"), *cid, lookup, "medium", "p", "known"),
        _entry_sql(1, "i", 4, AT.format("Concentration"), *user, "'supplied and structurally validated'", "unverified", "p"),
        _entry_sql(2, NUMBER, 0, PATH, "level", "NULL", "'resolved from supplied measured-property evidence'", "high", "resolved", "status = 'resolved'"),
        _entry_sql(3, "i", 0, f"'{generation.SOURCE_SMILES}'", *cid, "'PubChem CAS lookup (' || CASE WHEN k % 6 = 0 THEN 'ConnectivitySMILES fallback' ELSE 'SMILES' END || ')'", "medium", "p", "known AND normal"),
    ]
    return RESOLVED_SQL + "," + PARTS_SQL + ", every_row AS (" + " UNION ALL ".join(rows) + ") SELECT product, CAST(row_number() OVER (PARTITION BY product ORDER BY part, place, k) - 1 AS INTEGER) AS ordinal, path, source_type, source_reference, method, confidence, warned FROM every_row"


@query(_provenance_sql())
def generation_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generation.provenance(*inputs(spark, sf_dir), resolution.resolved(*evidence(spark, sf_dir)))
    return found.select("product", "ordinal", "path", "source_type", "source_reference", "method", "confidence", F.col("warning").isNotNull().alias("warned"))


@query(RESOLVED_SQL + "," + PARTS_SQL + f""", u AS (
  SELECT product, 0 AS part, i AS place, {AT.format(generation.CAS_NO)} AS path, 'missing_input' AS reason, false AS blocks_release FROM p WHERE NOT known AND valid AND coalesce(outcome <> 'ambiguous', true)
  UNION ALL SELECT product, 1, {NUMBER}, {PATH}, reason, reason = 'conflicting_sources' FROM resolved WHERE status = 'unresolved'
  UNION ALL SELECT product, 2, i, {AT.format(generation.CAS_NO)}, 'ambiguous_chemical_identity', true FROM p WHERE outcome = 'ambiguous')
SELECT product, CAST(row_number() OVER (PARTITION BY product ORDER BY part, place) - 1 AS INTEGER) AS ordinal, path, reason, blocks_release FROM u""")
def generation_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.unresolved(*inputs(spark, sf_dir), resolution.resolved(*evidence(spark, sf_dir)))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that resolve properties, with what is measured beside the value."""
    products, entries, sources = evidence(spark, sf_dir)
    best = resolution.resolving_entries(products, entries, sources)
    number, value = F.col("product") + F.col("value"), F.col("value").cast("double")
    return best.select(
        "product", "property", value.alias("value"), F.when(number % 4 != 0, value).alias("lower"), F.when(number % 4 != 1, value + 10.5).alias("upper"), F.lit("u").alias("unit"), "method", "temperature",
        F.when(number % 2 == 0, F.lit(101.325)).alias("pressure"), F.when(number % 3 == 0, "air").alias("atmosphere"), F.concat(F.lit("result "), F.col("value").cast("string")).alias("result"),
    )


def _exact(value: str) -> str:
    return f"""'"NumericRangeWithUnitAndQualifier":{{"ExactValue":{{"Value":' || {value} || '}},"Unit":"u"}},"Method":"closed cup"'"""


SAID = "concat_ws(', ', CASE WHEN t IS NOT NULL THEN '20°C' END, CASE WHEN n % 2 = 0 THEN '101.325 kPa' END, CASE WHEN n % 3 = 0 THEN 'air' END)"
SAID = f"""CASE WHEN {SAID} = '' THEN '' ELSE ',"Condition":"' || {SAID} || '"' END"""
OTHER = """CASE WHEN n % 3 = 0 THEN '"OtherCondition":"air"' END"""


@query(RESOLVED_SQL + f""",
m AS (SELECT product, property, best.value::DOUBLE AS v, best.value AS whole, best.temperature AS t, product + best.value AS n FROM judged WHERE reason IS NULL),
f AS (SELECT product, property, CASE property
  WHEN 'FlashPoint' THEN '"FlashPoint":[{{' || {_exact('v')} || {SAID} || '}}]'
  WHEN 'InitialBoilingPointAndBoilingRange' THEN '"BoilingPointRelated":[{{"ItemName":"Initial boiling point / boiling range",' || {_exact('v')} || ',"Condition":{{' || concat_ws(',', CASE WHEN n % 2 = 0 THEN '"PressureValue":101.325,"Unit":"kPa"' END, {OTHER}) || '}}}}]'
  WHEN 'VapourPressure' THEN '"VapourPressure":[{{' || {_exact('v')} || ',"Condition":{{' || concat_ws(',', CASE WHEN t IS NOT NULL THEN '"Temperature":20.0,"Unit":"°C"' END, {OTHER}) || '}}}}]'
  WHEN 'ExplosiveLimits' THEN '"ExplosionLimit":[' || concat_ws(',', CASE WHEN n % 4 <> 0 THEN '{{"ItemName":"Lower Explosive Limit",' || {_exact('v')} || {SAID} || '}}' END, CASE WHEN n % 4 <> 1 THEN '{{"ItemName":"Upper Explosive Limit",' || {_exact('(v + 10.5::DOUBLE)')} || {SAID} || '}}' END) || ']'
  WHEN 'SelfReactivity' THEN '"SelfReactivityAndExplosiveness":"result ' || whole || ' (method: closed cup)"' WHEN 'OxidizingProperties' THEN '"OxidizingProperties":"result ' || whole || ' (method: closed cup)"'
  ELSE '"CorrosiveToMetals":"result ' || whole || ' (method: closed cup)"' END AS field FROM m),
sections AS (SELECT product, string_agg(field, ',' ORDER BY {NUMBER}) FILTER (WHERE {NUMBER} <= 4) AS physical, string_agg(field, ',' ORDER BY {NUMBER}) FILTER (WHERE {NUMBER} IN (5, 6)) AS reactive, max(field) FILTER (WHERE {NUMBER} = 7) AS corrosive FROM f GROUP BY product)
SELECT product, '{{' || concat_ws(',', '"HazardIdentification":{{"Classification":{{"PhysicochemicalEffect":{{' || corrosive || '}}}}}}', '"PhysicalChemicalProperties":{{' || physical || '}}', '"StabilityReactivity":{{"HazardousReactions":{{' || reactive || '}}}}') || '}}' AS record FROM sections""")  # fmt: skip
def generation_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generation.property_sections(measured(spark, sf_dir))
    return found.select("product", F.to_json(F.struct("HazardIdentification", "PhysicalChemicalProperties", "StabilityReactivity")).alias("record"))

"""Safety-document views over the order tables: an order is a document, its line
items are components. Defects are injected by integer arithmetic, the same in both
engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..sources.schema import DDL

LANGS = ["ja", "en", "zh-cn", "zh-tw"]


#: Section 9 with two quantities that lack a unit, and with none.
WITHOUT_UNITS = (
    '{"FlashPoint":[{"NumericRangeWithUnitAndQualifier":{"ExactValue":{"Value":23},"Unit":" "}}],"Solubilities":{"WaterSolubility":[{"NumericRangeWithUnitAndQualifier":{"LowerValue":{"Value":1},"UpperValue":{"Value":2}}}]},'
    '"Densities":[{"NumericRangeWithUnitAndQualifier":{"ExactValue":{"Value":1},"Unit":"g/cm3"}},{"NumericRangeWithUnitAndQualifier":{"ExactValue":{"Value":1},"AdditionalInfo":{"FullText":["relative"]}}}]}'
)
WITH_UNITS = '{"Densities":[{"NumericRangeWithUnitAndQualifier":{"ExactValue":{"Value":1},"Unit":"g/cm3"}}]}'
#: Classifications without a hazard, and with one among entries that are none.
NO_HAZARD = '{"HazardName":"Not classified","AcuteToxicity":"N/A"}'
ONE_HAZARD = '{"AcuteToxicity":"Not classified","FlammableLiquids":"Category 2","HazardName":"Not applicable"}'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, cas, name, conc, h_code, un)."""
    li = table(spark, sf_dir, "lineitem")
    order, line, part, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    body = F.when(order % 50 == 0, 12345).otherwise(10000 + (part * 7919) % 90000)
    two = F.when(order % 50 == 0, 67).otherwise(supp % 100)
    # the digits from the right times their place, as in the SQL below
    at = lambda n, power: F.call_function("div", n, F.lit(10**power)) % 10
    right = at(two, 0) + at(two, 1) * 2 + at(body, 0) * 3 + at(body, 1) * 4 + at(body, 2) * 5 + at(body, 3) * 6 + at(body, 4) * 7
    digit = ((right + F.when((order + line) % 11 == 0, 1).otherwise(0)) % 10).cast("string")
    dash = F.when((order + line) % 17 == 0, "/").otherwise("-")
    cas = F.when((order + line) % 19 == 0, F.lit("")).otherwise(F.concat(body.cast("string"), dash, F.lpad(two.cast("string"), 2, "0"), F.lit("-"), digit))
    return li.select(
        order.alias("doc"), line.alias("pos"), cas.alias("cas"),
        F.when(part % 13 != 0, F.concat(F.lit("substance "), (part % 997).cast("string"))).alias("name"),
        (F.col("l_quantity") * 2.0 + F.when((order + line) % 23 == 0, F.lit(60.0)).otherwise(F.lit(0.0))).alias("conc"),
        _pick(chemistry.H_CODES, supp * 31 + line).alias("h_code"), (1000 + supp % 3000).cast("string").alias("un"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, lang, supplier, issue_date, revision_date, trade_name)."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        key.alias("doc"), _pick(LANGS, cust).alias("lang"), F.concat(F.lit("M"), (cust % 53).cast("string")).alias("supplier"),
        F.when(key % 29 == 0, F.lit("unknown")).otherwise(day).alias("issue_date"),
        F.when(key % 31 == 0, F.lit("May")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS"), "yyyy-MM-dd")).alias("revision_date"),
        F.when(key % 37 == 0, F.lit("N/A")).when(key % 41 == 0, F.lit(None)).otherwise(F.concat(F.lit("Product "), key.cast("string"))).alias("trade_name"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: (doc, lang, supplier and the section columns)."""
    parts = components(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "cas", "name", "conc", "h_code"))).alias("c"))
    docs = documents(spark, sf_dir).join(parts, "doc", "left")
    key = F.col("doc")
    c = F.coalesce(F.col("c"), F.array().cast("array<struct<pos:int,cas:string,name:string,conc:double,h_code:string>>"))
    null = F.lit(None).cast("string")
    value = lambda v: F.struct(null.alias("ValueSymbol"), v.alias("Value"))
    none = F.lit(None).cast("struct<ValueSymbol:string,Value:double>")
    quantity = lambda x: F.struct(
        value(x["conc"]).alias("ExactValue"), none.alias("LowerValue"), none.alias("UpperValue"),
        F.when((key + x["pos"]) % 43 == 0, null).otherwise("%").alias("Unit"), F.lit(None).cast("struct<ItemName:string,FullText:array<string>>").alias("AdditionalInfo"),
    )
    row = lambda x: F.struct(
        F.struct(
            F.struct(null.alias("IupacName"), null.alias("CasInventoryName"), x["name"].alias("GenericName")).alias("SubstanceNames"),
            F.struct(F.lit(None).cast("array<string>").alias("OtherName")).alias("CommonName"),
            F.struct(F.struct(F.array(x["cas"]).alias("FullText")).alias("CASno")).alias("SubstanceIdentity"),
        ).alias("SubstanceIdentifiers"),
        null.alias("MolecularFormula"), null.alias("SMILES"), F.lit(None).cast("double").alias("MolecularWeight"),
        F.struct(quantity(x).alias("NumericRangeWithUnitAndQualifier")).alias("Concentration"),
    )
    code = lambda x: F.when((key + x["pos"]) % 47 == 0, F.concat(F.lit("H9"), F.substring(x["h_code"], 3, 2))).otherwise(x["h_code"])
    labelling = F.struct(
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("GHS07"))).alias("HazardPictogram"),
        F.when(key % 7 == 0, F.lit(" ")).otherwise("Danger").alias("SignalWord"),
        F.transform(c, lambda x: F.struct(code(x).alias("HazardStatementCode"), null.alias("FullText"))).alias("HazardStatement"),
    )
    text = lambda skip: F.when(key % skip == 0, null).otherwise("some text")
    sections = {
        "Datasheet": F.struct(F.col("issue_date").alias("IssueDate"), F.array("revision_date").alias("RevisionDate"), null.alias("SDS-SchemaVersionNo")),
        "Identification": F.struct(
            F.struct(null.alias("TradeNameJP"), F.col("trade_name").alias("TradeNameEN")).alias("TradeProductIdentity"),
            F.when(key % 11 != 0, F.struct(F.col("supplier").alias("CompanyName"))).alias("SupplierInformation"),
        ),
        "HazardIdentification": F.when(key % 53 != 0, F.struct(F.when(key % 9 == 1, F.lit(NO_HAZARD)).when(key % 9 != 0, F.lit(ONE_HAZARD)).alias("Classification"), labelling.alias("HazardLabelling"))),
        "Composition": F.struct(F.lit("mixture").alias("CompositionType"), F.transform(c, row).alias("CompositionAndConcentration")),
        "StabilityReactivity": F.when(key % 59 != 0, F.struct(text(3).alias("StabilityDescription"), text(2).alias("ReactivityDescription"))),
        "ToxicologicalInformation": F.when(key % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))),
        "EcologicalInformation": F.when(key % 61 != 0, F.array(F.lit("x"))),
        "TransportInformation": F.struct(F.array(F.struct((1000 + key % 3000).cast("string").alias("UNNumber"), text(6).alias("ProperShippingName"), text(10).alias("PackingGroup"))).alias("InternationalRegulations")),
    }
    plain = {"FirstAidMeasures": 17, "FireFightingMeasures": 19, "AccidentalReleaseMeasures": 23, "HandlingAndStorage": 67, "ExposureControlPersonalProtection": 71, "DisposalConsiderations": 73, "RegulatoryInformation": 79, "OtherInformation": 83}
    sections |= {name: text(skip) for name, skip in plain.items()}
    sections["PhysicalChemicalProperties"] = F.when(key % 43 == 0, F.lit(WITHOUT_UNITS)).when(key % 43 == 1, F.lit(WITH_UNITS))
    out = docs.select("doc", "lang", "supplier", *(x.alias(n) for n, x in sections.items()))
    fill = {"HazardIdentification": DDL["HazardIdentification"], "Identification": DDL["Identification"]}
    for name, kind in fill.items():
        out = out.withColumn(name, F.from_json(F.to_json(name), kind))
    return out


# The same views for DuckDB. A check digit is the sum of the digits from the right
# times their place; the body has five digits and the second part two.
H_SQL = "[" + ", ".join(f"'{h}'" for h in chemistry.H_CODES) + "]"
COMPONENTS_SQL = f"""
base AS (
  SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN l_orderkey % 50 = 0 THEN 12345 ELSE 10000 + (l_partkey * 7919) % 90000 END AS body, CASE WHEN l_orderkey % 50 = 0 THEN 67 ELSE l_suppkey % 100 END AS two, l_partkey, l_suppkey, l_quantity FROM lineitem),
digits AS (
  SELECT *, lpad(CAST(two AS VARCHAR), 2, '0') AS two_s,
    ((two % 10) * 1 + (two // 10) * 2 + (body % 10) * 3 + (body // 10 % 10) * 4 + (body // 100 % 10) * 5 + (body // 1000 % 10) * 6 + (body // 10000) * 7) % 10 AS rightd FROM base),
components AS (
  SELECT doc, pos, rightd, body, two_s,
    CASE WHEN (doc + pos) % 19 = 0 THEN ''
         WHEN (doc + pos) % 17 = 0 THEN body || '/' || two_s || '-' || (rightd + CASE WHEN (doc + pos) % 11 = 0 THEN 1 ELSE 0 END) % 10
         ELSE body || '-' || two_s || '-' || (rightd + CASE WHEN (doc + pos) % 11 = 0 THEN 1 ELSE 0 END) % 10 END AS cas,
    CASE WHEN (doc + pos) % 19 = 0 OR (doc + pos) % 17 = 0 THEN 'format' WHEN (doc + pos) % 11 = 0 THEN 'checkdigit' ELSE 'ok' END AS status,
    CASE WHEN l_partkey % 13 <> 0 THEN 'substance ' || (l_partkey % 997) END AS name,
    l_quantity * 2.0::DOUBLE + CASE WHEN (doc + pos) % 23 = 0 THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END AS conc,
    {H_SQL}[1 + (l_suppkey * 31 + pos) % {len(chemistry.H_CODES)}] AS h_code, CAST(1000 + l_suppkey % 3000 AS VARCHAR) AS un
  FROM digits)"""
DOCUMENTS_SQL = """
docs AS (
  SELECT o_orderkey AS doc, ['ja', 'en', 'zh-cn', 'zh-tw'][1 + o_custkey % 4] AS lang, 'M' || (o_custkey % 53) AS supplier,
    CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issue_date,
    CASE WHEN o_orderkey % 31 = 0 THEN 'May' ELSE strftime(o_orderdate + INTERVAL 40 DAYS, '%Y-%m-%d') END AS revision_date,
    CASE WHEN o_orderkey % 37 = 0 THEN 'N/A' WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'Product ' || o_orderkey END AS trade_name
  FROM orders)"""

"""Drafts of records out of product inputs, where their fields come from, and what is open.

products: (product, trade_name, other_names, company_name, address, phone, email), one row a
product; components: (product, pos, name, cas, exact, lower, upper, unit), one row a component
in the order of pos; identities: (cas, outcome, iupac_name, formula, cid, mismatch,
source_smiles, fallback), one row a looked-up number, outcome ``resolved`` or another.

A list of a product is numbered in one shuffle by product. Products of more than CELL
components are few (one of CELL rows at most) and go apart: their lists are numbered over
cells of their rows, so a product that holds most rows of the input is in no one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry
from .resolution import POLICIES, blocks

# Paths of the fields that are drafted, and of the measured properties.
PRODUCT_FIELDS = {
    "trade_name": "Identification.TradeProductIdentity.TradeNameJP", "other_names": "Identification.TradeProductIdentity.OtherName",
    "company_name": "Identification.SupplierInformation.CompanyName", "address": "Identification.SupplierInformation.Address",
    "phone": "Identification.SupplierInformation.Phone", "email": "Identification.SupplierInformation.Email",
}
ROWS = "Composition.CompositionAndConcentration"
CAS_NO = "SubstanceIdentifiers.SubstanceIdentity.CASno"
GENERIC_NAME, IUPAC_NAME = "SubstanceIdentifiers.SubstanceNames.GenericName", "SubstanceIdentifiers.SubstanceNames.IupacName"
SOURCE_SMILES = "Structure.SourceSmiles (report-only, no schema field)"
PROPERTY_PATHS = {
    "FlashPoint": "PhysicalChemicalProperties.FlashPoint", "InitialBoilingPointAndBoilingRange": "PhysicalChemicalProperties.InitialBoilingPointAndBoilingRange",
    "VapourPressure": "PhysicalChemicalProperties.VapourPressure", "ExplosiveLimits": "PhysicalChemicalProperties.ExplosiveLimits",
    "SelfReactivity": "StabilityReactivity.SelfReactivity", "OxidizingProperties": "PhysicalChemicalProperties.OxidizingProperties", "CorrosiveToMetals": "HazardIdentification.Classification.PhysicochemicalEffect.CorrosiveToMetals",
}

# What the report says of how a field was come by.
FROM_PRODUCT, FROM_COMPONENT = "supplied in ProductInput", "supplied in ComponentInput"
CHECKED, VALIDATED = "supplied and check-digit validated", "supplied and structurally validated"
LOOKED_UP = "CAS lookup through existing enrichment layer (PubChem)"
MEASURED = "resolved from supplied measured-property evidence"
FULL_SMILES, FALLBACK_SMILES = "PubChem CAS lookup (SMILES)", "PubChem CAS lookup (ConnectivitySMILES fallback)"
FALLBACK_WARNING = "connectivity-only SMILES used as fallback -- stereochemistry/isotope information may not be represented"
COMPOUND = "PubChem CID "

#: Positions that are numbered together, and components of a product that goes without cells.
CELL = 1_024

ENTRY = "struct<path:string,source_type:string,source_reference:string,method:string,confidence:string,warning:string>"


def numbered(rows: DataFrame, group: str, order: list[str], name: str, cell: Column | None = None, size: str | None = None) -> DataFrame:
    """``rows`` with ``name``: their number from 0 among the rows of their group in the
    given order, without gaps; with ``size``, a row counts for so many. ``cell`` cuts a
    group into runs of that order: rows are numbered within a run, and the runs' sizes give
    each its start. Without one a group is in one task. Rows that are equal in all of
    ``order`` may change places."""

    def own(*keys: str) -> Column:
        within = Window.partitionBy(*keys).orderBy(*order)
        return F.row_number().over(within) - 1 if size is None else F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if cell is None:
        return rows.withColumn(name, own(group).cast("int"))
    rows = rows.select("*", cell.alias("_cell"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_cell").agg((F.count("*") if size is None else F.sum(size)).alias("_n"))
    starts = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.withColumn("_own", own(group, "_cell")).join(starts, [group, "_cell"]).withColumn(name, (F.col("_start") + F.col("_own")).cast("int")).drop("_cell", "_own", "_start")


def _cells(place: str, *first: str) -> Column:
    return F.struct(*first, F.floor(F.col(place) / CELL).alias("cell"))


def _apart(components: DataFrame, of: Callable[..., DataFrame], *tables: DataFrame) -> DataFrame:
    """``of(components, *tables, cells)`` of the products with few components, without cells,
    and of those with more than CELL, with them. Every table has a column ``product``. The
    large products are looked for at once, since a plan of both kinds does all steps twice."""
    large = components.groupBy("product").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL).select("product").persist()
    if large.isEmpty():
        large.unpersist()
        return of(components, *tables, False)
    large = F.broadcast(large)
    few, many = ([t.join(large, "product", how) for t in (components, *tables)] for how in ("left_anti", "left_semi"))
    return of(*few, False).unionByName(of(*many, True))


KEYS = ["pos", "cas", "name", "exact", "lower", "upper", "unit"]


def _looked_up(components: DataFrame, identities: DataFrame) -> DataFrame:
    """``components`` with what their number's lookup returned; a number that very many
    components have is a skewed side of a plain join."""
    known = identities.select(F.col("cas").alias("_cas"), *(c for c in identities.columns if c != "cas"))
    return components.join(known, F.col("cas") == F.col("_cas"), "left").drop("_cas").withColumn("resolved", F.coalesce(F.col("outcome") == "resolved", F.lit(False)))


def _indexed(components: DataFrame, cells: bool) -> DataFrame:
    return numbered(components, "product", KEYS, "index", _cells("pos") if cells else None)


def indexed(components: DataFrame, identities: DataFrame) -> DataFrame:
    """``components`` with their ``index`` in the product and what their number's lookup
    returned."""
    return _apart(components, lambda rows, cells: _looked_up(_indexed(rows, cells), identities))


def drafts(products: DataFrame, components: DataFrame, identities: DataFrame) -> DataFrame:
    """(product, Identification, Composition): sections 1 and 3 as far as the input goes.
    Empty lists are null, ranges stay ranges, a number's names come from its lookup, and a
    formula that the structure contradicts is left out."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    identification = F.struct(
        F.struct(F.col("trade_name").alias("TradeNameJP"), filled("other_names").alias("OtherName")).alias("TradeProductIdentity"),
        F.struct(F.col("company_name").alias("CompanyName"), F.col("address").alias("Address"), F.col("phone").alias("Phone"), F.col("email").alias("Email")).alias("SupplierInformation"),
    )
    if_known = lambda x, c: F.when(x["resolved"], c)
    some = lambda c: F.when(c.isNotNull(), F.struct(c.alias("Value")))

    def row(x: Column) -> Column:
        identity = F.when(x["cas"].isNotNull(), F.struct(F.struct(F.array(x["cas"]).alias("FullText")).alias("CASno")))
        names = F.struct(if_known(x, x["iupac_name"]).alias("IupacName"), x["name"].alias("GenericName"))
        substance = F.when(x["name"].isNotNull() | x["cas"].isNotNull(), F.struct(names.alias("SubstanceNames"), identity.alias("SubstanceIdentity")))
        unit = F.when(F.trim(x["unit"]) != "", x["unit"])
        quantity = F.struct(some(x["exact"]).alias("ExactValue"), some(x["lower"]).alias("LowerValue"), some(x["upper"]).alias("UpperValue"), unit.alias("Unit"))
        return F.struct(
            substance.alias("SubstanceIdentifiers"), if_known(x, F.when(~F.coalesce(x["mismatch"], F.lit(False)), x["formula"])).alias("MolecularFormula"),
            F.struct(quantity.alias("NumericRangeWithUnitAndQualifier")).alias("Concentration"),
        )

    # a product's components are one record in the end, so they are put in order there
    listed = F.array_sort(F.collect_list(F.struct(*KEYS, "resolved", "iupac_name", "mismatch", "formula")))
    parts = _looked_up(components, identities).groupBy("product").agg(listed.alias("_rows"))
    composition = F.when(F.size("_rows") > 0, F.struct(F.transform("_rows", row).alias("CompositionAndConcentration")))
    return products.join(parts, "product", "left").select("product", identification.alias("Identification"), composition.alias("Composition"))


def _entry(path: Column | str, source: Column | str, method: str, confidence: str, reference: Column | None = None, warning: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return F.struct(text(path).alias("path"), text(source).alias("source_type"), (none if reference is None else reference).alias("source_reference"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), (none if warning is None else warning).alias("warning")).cast(ENTRY)


def _supplied(path: Column | str, method: str) -> Column:
    return _entry(path, "unverified_user_input", method, "unverified")


def provenance(products: DataFrame, components: DataFrame, identities: DataFrame, properties: DataFrame) -> DataFrame:
    """(product, ordinal, path, source_type, source_reference, method, confidence, warning):
    where each field of the draft comes from. A product's own fields come first, then its
    components, each with its supplied and its looked-up fields, then the measured
    ``properties`` (``resolution.resolved``) in policy order, then the structures that
    lookups returned. Ordinals start at 0 and have no gaps."""
    return _apart(components, lambda rows, own, known, cells: _provenance(own, rows, identities, known, cells), products, properties)


def _bits(*when: Column) -> Column:
    return sum((F.when(w, 1 << n).otherwise(0) for n, w in enumerate(when)), F.lit(0))


def _provenance(products: DataFrame, components: DataFrame, identities: DataFrame, properties: DataFrame, cells: bool) -> DataFrame:
    given = {c: F.col(c).isNotNull() for c in PRODUCT_FIELDS} | {"trade_name": F.lit(True), "company_name": F.lit(True), "other_names": F.coalesce(F.size("other_names") > 0, F.lit(False))}
    # lists are numbered by what they have, before their entries are written out
    none = {"cid": F.lit(None).cast("string"), "fallback": F.lit(False), "property": F.lit(None).cast("string"), "level": F.lit(None).cast("string")}
    listed = lambda rows, part, place, has, **own: rows.select("product", part.cast("int").alias("part"), place.cast("long").alias("place"), has.alias("has"), *(c.alias(n) for n, c in (none | own).items())).where("has <> 0")
    of_component = _bits(F.col("named"), F.col("cas").isNotNull(), F.col("resolved") & F.col("iupac_name").isNotNull(), F.col("resolved") & F.col("formula").isNotNull(), F.lit(True))
    structure = _bits(F.col("resolved") & F.col("source_smiles").isNotNull())
    two = F.explode(F.array(*(F.struct(F.lit(part).alias("part"), has.alias("has")) for part, has in ((1, of_component), (3, structure)))))
    # a component meets its lookup with its number, not with what it was put in order by
    indexed = _indexed(components, cells).select("product", "index", "cas", F.col("name").isNotNull().alias("named"))
    parts = _looked_up(indexed, identities).select("product", "index", "cid", "fallback", two.alias("l"))
    rows = listed(products, F.lit(0), F.lit(0), _bits(*(given[c] for c in PRODUCT_FIELDS)))
    rows = rows.unionByName(listed(parts, F.col("l.part"), F.col("index"), F.col("l.has"), cid=F.col("cid").cast("string"), fallback=F.coalesce("fallback", F.lit(False))))
    rows = rows.unionByName(listed(properties.where("status = 'resolved'"), F.lit(2), _policy_number(), F.lit(1), property=F.col("property"), level=F.col("level")))
    rows = numbered(rows.withColumn("n", F.bit_count("has")), "product", ["part", "place"], "start", _cells("place", "part") if cells else None, "n")
    at = lambda field: F.concat(F.lit(f"{ROWS}["), F.col("place").cast("string"), F.lit(f"].{field}"))
    compound = F.concat(F.lit(COMPOUND), F.col("cid"))
    looked_up = lambda field: _entry(at(field), "reference_database", LOOKED_UP, "medium", compound)
    source = F.when(F.col("fallback"), _entry(SOURCE_SMILES, "reference_database", FALLBACK_SMILES, "medium", compound, F.lit(FALLBACK_WARNING)))
    source = source.otherwise(_entry(SOURCE_SMILES, "reference_database", FULL_SMILES, "medium", compound))
    entries = [
        [_supplied(path, FROM_PRODUCT) for path in PRODUCT_FIELDS.values()],
        [_supplied(at(GENERIC_NAME), FROM_COMPONENT), _supplied(at(CAS_NO), CHECKED), looked_up(IUPAC_NAME), looked_up("MolecularFormula"), _supplied(at("Concentration"), VALIDATED)],
        [_entry(_path(F.col("property")), F.col("level"), MEASURED, "high")],
        [source],
    ]
    of_part = F.lit(None).cast(f"array<{ENTRY}>")
    for part, own in enumerate(entries):
        has = [F.when(F.col("has").bitwiseAND(F.lit(1 << n)) != 0, e) for n, e in enumerate(own)]
        of_part = F.when(F.col("part") == part, F.array_compact(F.array(*has))).otherwise(of_part)
    each = rows.select("product", "start", F.posexplode_outer(of_part).alias("k", "e"))
    return each.select("product", (F.col("start") + F.col("k")).alias("ordinal"), "e.*")


def _policy_number() -> Column:
    return F.array_position(F.array(*map(F.lit, POLICIES)), F.col("property"))


def _path(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in PROPERTY_PATHS.items() for x in kv))[name]


def upserted(rows: DataFrame, key: str, path: str, order: list[str]) -> DataFrame:
    """``rows`` with one row for each key and path, the last in the given order, in one
    aggregate for any number of writers and paths: what is written again replaces what
    was there and takes the place of the later."""
    value = F.struct(*(c for c in rows.columns if c not in (key, path)))
    last = rows.groupBy(key, path).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    return last.select(key, path, "_last.*").select(*rows.columns)


def unresolved(products: DataFrame, components: DataFrame, identities: DataFrame, properties: DataFrame) -> DataFrame:
    """(product, ordinal, path, reason, blocks_release): the fields that are open. A valid
    number that was not resolved is a missing input; if its lookup was ambiguous that
    replaces it, at the end of the list, and blocks the release. A measured property is
    open for the reason that ``resolution.resolved`` gives."""
    return _apart(components, lambda rows, own, known, cells: _unresolved(own, rows, identities, known, cells), products, properties)


def _unresolved(products: DataFrame, components: DataFrame, identities: DataFrame, properties: DataFrame, cells: bool) -> DataFrame:
    row = lambda rows, part, place, reason: rows.select("product", part.alias("part"), place.cast("long").alias("place"), reason.alias("reason"))
    ambiguous = F.coalesce(F.col("outcome") == "ambiguous", F.lit(False))
    missing = ~F.col("resolved") & (chemistry.cas_status(F.col("cas")) == "ok")
    # an ambiguous number has one row only, as that replaces the other
    numbers = _indexed(components, cells).where("cas is not null").select("product", "index", "cas")
    parts = _looked_up(numbers, identities.select("cas", "outcome")).where(ambiguous | missing)
    rows = row(parts, F.when(ambiguous, 2).otherwise(0), F.col("index"), F.when(ambiguous, "ambiguous_chemical_identity").otherwise("missing_input"))
    rows = rows.unionByName(row(properties.where("status = 'unresolved'"), F.lit(1), _policy_number(), F.col("reason")))
    # a field is a part and a place here; its path is written out in the end
    of_property = F.col("part") == 1
    rows = rows.join(products.select("product"), "product", "left_semi").withColumn("field", F.struct(of_property.alias("property"), "place"))
    last = upserted(rows, "product", "field", ["part", "place"])
    out = numbered(last, "product", ["part", "place"], "ordinal", _cells("place", "part") if cells else None)
    at = F.concat(F.lit(f"{ROWS}["), F.col("place").cast("string"), F.lit(f"].{CAS_NO}"))
    path = F.when(of_property, _path(F.get(F.array(*map(F.lit, POLICIES)), (F.col("place") - 1).cast("int")))).otherwise(at)
    stops = F.when(of_property, blocks(F.col("reason"))).otherwise(F.col("part") == 2)
    return out.select("product", "ordinal", path.alias("path"), "reason", stops.alias("blocks_release"))


def plain_number(c: Column) -> Column:
    """A number without the zero behind a bare point."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def conditions(temperature: Column, pressure: Column, atmosphere: Column) -> Column:
    """What a value was measured at, in words; null if nothing is said."""
    said = F.array_compact(F.array(F.concat(plain_number(temperature), F.lit("°C")), F.concat(plain_number(pressure), F.lit(" kPa")), atmosphere))
    return F.when(F.size(said) > 0, F.array_join(said, ", "))


def property_sections(best: DataFrame) -> DataFrame:
    """(product, HazardIdentification, PhysicalChemicalProperties, StabilityReactivity) out of
    the measurements that resolve properties: ``best`` is (product, property, value, lower,
    upper, unit, method, temperature, pressure, atmosphere, result), at most one row a
    product and property. A section, list or field without a measurement is null."""
    is_ = lambda name, x: F.max(F.when(F.col("property") == name, x))
    exact = lambda c: F.struct(F.struct(F.col(c).alias("Value")).alias("ExactValue"), F.col("unit").alias("Unit")).alias("NumericRangeWithUnitAndQualifier")
    method, other = F.col("method").alias("Method"), F.col("atmosphere").alias("OtherCondition")
    said = conditions(F.col("temperature"), F.col("pressure"), F.col("atmosphere")).alias("Condition")
    with_unit = lambda c, unit: F.when(F.col(c).isNotNull(), unit).alias("Unit")
    result = F.when(F.col("method").isNull(), F.col("result")).otherwise(F.concat("result", F.lit(" (method: "), "method", F.lit(")")))
    limit = lambda name, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("ItemName"), exact(c), method, said))
    limits = F.array_compact(F.array(limit("Lower Explosive Limit", "lower"), limit("Upper Explosive Limit", "upper")))
    fields = best.groupBy("product").agg(
        is_("FlashPoint", F.array(F.struct(exact("value"), method, said))).alias("flash"),
        is_("InitialBoilingPointAndBoilingRange", F.array(F.struct(F.lit("Initial boiling point / boiling range").alias("ItemName"), exact("value"), method, F.struct(F.col("pressure").alias("PressureValue"), with_unit("pressure", "kPa"), other).alias("Condition")))).alias("boiling"),
        is_("VapourPressure", F.array(F.struct(exact("value"), method, F.struct(F.col("temperature").alias("Temperature"), with_unit("temperature", "°C"), other).alias("Condition")))).alias("vapour"),
        is_("ExplosiveLimits", F.when(F.size(limits) > 0, limits)).alias("limits"),
        is_("SelfReactivity", result).alias("reactive"), is_("OxidizingProperties", result).alias("oxidizing"), is_("CorrosiveToMetals", result).alias("corrosive"),
    )
    some = lambda *names: F.size(F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), 1) for n in names)))) > 0
    reactions = F.struct(F.col("reactive").alias("SelfReactivityAndExplosiveness"), F.col("oxidizing").alias("OxidizingProperties"))
    return fields.select(
        "product", F.when(some("corrosive"), F.struct(F.struct(F.struct(F.col("corrosive").alias("CorrosiveToMetals")).alias("PhysicochemicalEffect")).alias("Classification"))).alias("HazardIdentification"),
        F.when(some("flash", "boiling", "vapour", "limits"), F.struct(F.col("flash").alias("FlashPoint"), F.col("boiling").alias("BoilingPointRelated"), F.col("vapour").alias("VapourPressure"), F.col("limits").alias("ExplosionLimit"))).alias("PhysicalChemicalProperties"),
        F.when(some("reactive", "oxidizing"), F.struct(reactions.alias("HazardousReactions"))).alias("StabilityReactivity"),
    )

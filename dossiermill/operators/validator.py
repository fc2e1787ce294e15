"""The record validator: structure, codes, CAS numbers, dates and consistency.

Rules run on the section columns of ``sources.schema``. Blank strings count as
present where a rule asks for presence and as absent where it asks for content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry, text
from ..sources.schema import NUMBERED
from .rules import Rule, findings
from .sections import leaves

CATEGORIES = ["Prevention", "Response", "Storage", "Disposal"]
STRUCTURAL = "STRUCTURAL"

_labelling = lambda: F.col("HazardIdentification.HazardLabelling")
_rows = lambda: F.col("Composition.CompositionAndConcentration")
_trade = lambda: F.col("Identification.TradeProductIdentity")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def h_codes() -> Column:
    return F.filter(F.transform(_labelling()["HazardStatement"], lambda s: s["HazardStatementCode"]), lambda c: c.isNotNull())


def p_codes() -> Column:
    of = lambda k: F.coalesce(_labelling()["PrecautionaryStatements"][k], F.array().cast("array<struct<PrecautionaryStatementCode:string,FullText:string>>"))
    codes = F.transform(F.concat(*map(of, CATEGORIES)), lambda s: s["PrecautionaryStatementCode"])
    return F.filter(codes, lambda c: c.isNotNull())


def cas_entries() -> Column:
    """(row, cas) of every CAS string, in order."""
    per_row = F.transform(_rows(), lambda r, i: F.transform(F.coalesce(r["SubstanceIdentifiers"]["SubstanceIdentity"]["CASno"]["FullText"], F.array().cast("array<string>")), lambda c: F.struct(i.alias("row"), c.alias("cas"))))
    return F.flatten(per_row)


def _missing(n: int, section: str) -> Rule:
    return Rule("WARN", STRUCTURAL, lambda: F.col(f"`{section}`").isNull(), f"Section {n} ({section}): section not extracted — check source document.")


def _cas_rule(status: str, message) -> Rule:  # noqa: ANN001
    return Rule("WARN", STRUCTURAL, lambda: F.filter(cas_entries(), lambda e: chemistry.cas_status(e["cas"]) == status), message, each=True)


def _names_of(row: Column) -> Column:
    """Whether a component has any name with content."""
    ids = row["SubstanceIdentifiers"]
    common = F.exists(F.coalesce(ids["CommonName"]["OtherName"], F.array().cast("array<string>")), lambda n: ~blank(n))
    return ~blank(ids["SubstanceNames"]["IupacName"]) | ~blank(ids["SubstanceNames"]["GenericName"]) | common


def _has_cas(row: Column) -> Column:
    return F.exists(F.coalesce(row["SubstanceIdentifiers"]["SubstanceIdentity"]["CASno"]["FullText"], F.array().cast("array<string>")), lambda c: ~blank(c))


def _out_of_range() -> Column:
    """The percent values outside 0 to 100: exact, lower and upper of each row in turn."""

    def values(row: Column) -> Column:
        q = row["Concentration"]["NumericRangeWithUnitAndQualifier"]
        three = F.array(*(q[k]["Value"] for k in ("ExactValue", "LowerValue", "UpperValue")))
        return F.when(F.contains(F.coalesce(q["Unit"], F.lit("")), F.lit("%")), F.filter(three, lambda v: (v < 0) | (v > 100))).otherwise(F.array().cast("array<double>"))

    return F.flatten(F.transform(_rows(), values))


def _statements_without(missing: Column) -> Column:
    return (F.size(F.coalesce(_labelling()["HazardStatement"], F.array().cast("array<struct<HazardStatementCode:string,FullText:string>>"))) > 0) & missing


def _un(missing: str):  # noqa: ANN202
    regs = F.col("TransportInformation.InternationalRegulations")
    return F.filter(F.transform(F.filter(regs, lambda r: ~blank(r["UNNumber"]) & blank(r[missing])), lambda r: r["UNNumber"]), lambda x: x.isNotNull())


#: A quantity in JSON text: an object with a value, and at most one level of objects inside.
_QUANTITY = r'(\{(?:[^{}]|\{[^{}]*\})*?"(?:ExactValue|LowerValue|UpperValue)"(?:[^{}]|\{[^{}]*\})*\})'


def _no_unit() -> Column:
    """Quantities of section 9, at any depth, with a value but neither a unit nor
    additional information."""
    found = F.regexp_extract_all(F.col("PhysicalChemicalProperties"), F.lit(_QUANTITY), F.lit(1))
    return F.filter(found, lambda q: ~q.rlike(r'"Unit"\s*:\s*"\s*[^"\s]') & ~q.rlike(r'"AdditionalInfo"\s*:'))


def _real_hazard() -> Column:
    """Whether any entry of the classification names a hazard."""
    return F.exists(leaves(F.col("HazardIdentification.Classification")), text.is_real_hazard)


def rules() -> list[Rule]:
    n = {s: i for i, s in enumerate(NUMBERED, 1)}
    structural = lambda when, message: Rule("WARN", STRUCTURAL, when, message)
    name = lambda: _trade()
    quoted = lambda before, after="": lambda x: F.concat(F.lit(before), x.cast("string"), F.lit(after))
    out = [
        _missing(1, "Identification"),
        structural(lambda: F.col("Identification").isNotNull() & name()["TradeNameJP"].isNull() & name()["TradeNameEN"].isNull(), "Section 1 (Identification): no product name (TradeNameJP/TradeNameEN)."),
        structural(lambda: F.col("Identification").isNotNull() & F.col("Identification.SupplierInformation").isNull(), "Section 1 (Identification): SupplierInformation is missing."),
        _missing(2, "HazardIdentification"),
        structural(lambda: F.col("HazardIdentification").isNotNull() & F.col("HazardIdentification.Classification").isNull() & _labelling().isNull(), "Section 2 (HazardIdentification): neither Classification nor HazardLabelling extracted."),
        Rule("WARN", STRUCTURAL, lambda: F.filter(h_codes(), lambda c: ~chemistry.known_h(c)), quoted("Section 2 (HazardStatement): unknown H-code '", "'"), each=True),
        Rule("WARN", STRUCTURAL, lambda: F.filter(p_codes(), lambda c: ~chemistry.known_p(c)), quoted("Section 2 (PrecautionaryStatement): unknown P-code '", "'"), each=True),
        _missing(3, "Composition"),
        structural(lambda: F.col("Composition").isNotNull() & (F.coalesce(F.size(_rows()), F.lit(0)) <= 0), "Section 3 (Composition): CompositionAndConcentration is empty."),
        _cas_rule("format", lambda e: F.concat(F.lit("Section 3 (Composition["), e["row"].cast("string"), F.lit("]): invalid CAS format '"), e["cas"], F.lit(r"' (expected \d{2,7}-\d{2}-\d)"))),
        _cas_rule("checkdigit", lambda e: F.concat(F.lit("Section 3 (Composition["), e["row"].cast("string"), F.lit("]): CAS check digit mismatch '"), e["cas"], F.lit("' (expected check digit "), chemistry.cas_check_digit(e["cas"]).cast("string"), F.lit(", source has "), F.substring(e["cas"], -1, 1), F.lit(")"))),
        *(_missing(n[s], s) for s in NUMBERED[3:10]),
        structural(lambda: F.col("StabilityReactivity").isNotNull() & F.col("StabilityReactivity.StabilityDescription").isNull() & F.col("StabilityReactivity.ReactivityDescription").isNull(), "Section 10 (StabilityReactivity): neither StabilityDescription nor ReactivityDescription extracted."),
    ]
    for s in ("ToxicologicalInformation", "EcologicalInformation"):
        out += [_missing(n[s], s), structural(lambda s=s: F.size(F.col(s)) == 0, f"Section {n[s]} ({s}): array is present but empty.")]
    out += [_missing(n[s], s) for s in NUMBERED[12:]]
    out += [
        Rule("WARN", STRUCTURAL, lambda: F.filter(F.array("Datasheet.IssueDate"), lambda d: ~text.looks_like_date(d)), quoted("Datasheet.IssueDate '", "' does not look like a valid date."), each=True),
        Rule("WARN", STRUCTURAL, lambda: F.filter(F.col("Datasheet.RevisionDate"), lambda d: ~text.looks_like_date(d)), quoted("Datasheet.RevisionDate '", "' does not look like a valid date."), each=True),
        *(Rule("WARN", STRUCTURAL, lambda k=k: F.filter(F.array(name()[k]), lambda v: text.is_placeholder(v)), quoted(f"Identification.{k} '", "' is a placeholder."), each=True) for k in ("TradeNameJP", "TradeNameEN")),
        Rule("WARN", STRUCTURAL, _out_of_range, quoted("Section 3 (Composition): concentration ", "% is outside 0–100."), each=True),
        structural(lambda: _real_hazard() & (F.coalesce(F.size(_labelling()["HazardStatement"]), F.lit(0)) <= 0), "Section 2: Classification names a hazard but HazardStatement is empty."),
        Rule("HIGH", "S2-GHS-INCOMPLETE", lambda: _statements_without(F.coalesce(F.size(_labelling()["HazardPictogram"]), F.lit(0)) <= 0), "HazardStatement without HazardPictogram."),
        Rule("HIGH", "S2-GHS-INCOMPLETE", lambda: _statements_without(blank(_labelling()["SignalWord"])), "HazardStatement without SignalWord."),
        Rule("HIGH", "S2-GHS-INCOMPLETE", lambda: _statements_without(F.col("HazardIdentification.Classification").isNull()), "HazardStatement without Classification."),
        Rule("HIGH", "S3-CAS-WITHOUT-NAME", lambda: F.transform(F.filter(F.transform(_rows(), lambda r, i: F.struct(i.alias("i"), (_has_cas(r) & ~_names_of(r)).alias("hit"))), lambda x: x["hit"]), lambda x: x["i"].cast("string")), quoted("Composition[", "] has a CAS number but no name."), each=True),
        Rule("HIGH", "S3-NAME-WITHOUT-CAS", lambda: F.transform(F.filter(F.transform(_rows(), lambda r, i: F.struct(i.alias("i"), (~_has_cas(r) & _names_of(r)).alias("hit"))), lambda x: x["hit"]), lambda x: x["i"].cast("string")), quoted("Composition[", "] has a name but no CAS number."), each=True),
        *(Rule("HIGH", "S14-UN-INCOMPLETE", lambda k=k: _un(k), quoted("UN ", f" has no {k}."), each=True) for k in ("ProperShippingName", "PackingGroup")),
        Rule("MED", "S2-DUPLICATE-HCODE", lambda: chemistry.repeats_of(h_codes()), quoted("Duplicate H-code ", "."), each=True),
        Rule("MED", "S2-DUPLICATE-PCODE", lambda: chemistry.repeats_of(p_codes()), quoted("Duplicate P-code ", "."), each=True),
        Rule("MED", "S9-VALUE-WITHOUT-UNIT", _no_unit, quoted("Section 9: value without a unit: "), each=True),
    ]
    return out


def validate(records: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``records`` with ``findings``, in rule order; of the rules ``names`` only, if given."""
    return records.withColumn("findings", findings([r for r in rules() if names is None or r.name in names]))

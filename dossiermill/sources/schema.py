"""The record: 17 optional sections. Fields that rules read are typed; all others of
a record stay available in its JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

# The sections in order; the first is administrative metadata.
SECTIONS = [
    "Datasheet", "Identification", "HazardIdentification", "Composition", "FirstAidMeasures",
    "FireFightingMeasures", "AccidentalReleaseMeasures", "HandlingAndStorage",
    "ExposureControlPersonalProtection", "PhysicalChemicalProperties", "StabilityReactivity",
    "ToxicologicalInformation", "EcologicalInformation", "DisposalConsiderations",
    "TransportInformation", "RegulatoryInformation", "OtherInformation",
]
NUMBERED = SECTIONS[1:]
#: Sections that are lists.
LISTS = ("ToxicologicalInformation", "EcologicalInformation")

_VALUE = "struct<ValueSymbol:string,Value:double>"
QUANTITY = f"struct<ExactValue:{_VALUE},LowerValue:{_VALUE},UpperValue:{_VALUE},Unit:string,AdditionalInfo:struct<ItemName:string,FullText:array<string>>>"
_PHRASE = "array<struct<PrecautionaryStatementCode:string,FullText:string>>"
_CONTACT = "array<struct<Phone:string>>"
_UN = "array<struct<UNNumber:string,ProperShippingName:string,PackingGroup:string>>"

DDL = {
    "Datasheet": "struct<IssueDate:string,RevisionDate:array<string>,`SDS-SchemaVersionNo`:string>",
    "Identification": f"struct<TradeProductIdentity:struct<TradeNameJP:string,TradeNameEN:string,OtherName:array<string>,ProductNoUser:array<string>>,SupplierInformation:struct<CompanyName:string,Phone:string,Address:string,Email:string,EmergencyContact:{_CONTACT}>,UseAndUseAdvisedAgainst:struct<Use:string>>",
    "HazardIdentification": f"struct<Classification:string,HazardLabelling:struct<HazardPictogram:array<string>,SignalWord:string,HazardStatement:array<struct<HazardStatementCode:string,FullText:string>>,PrecautionaryStatements:struct<Prevention:{_PHRASE},Response:{_PHRASE},Storage:{_PHRASE},Disposal:{_PHRASE}>>>",
    "Composition": f"struct<CompositionType:string,CompositionAndConcentration:array<struct<SubstanceIdentifiers:struct<SubstanceNames:struct<IupacName:string,CasInventoryName:string,GenericName:string>,CommonName:struct<OtherName:array<string>>,SubstanceIdentity:struct<CASno:struct<FullText:array<string>>>>,MolecularFormula:string,SMILES:string,MolecularWeight:double,Concentration:struct<NumericRangeWithUnitAndQualifier:{QUANTITY}>>>>",
    "StabilityReactivity": "struct<StabilityDescription:string,ReactivityDescription:string>",
    "ToxicologicalInformation": "array<string>",
    "EcologicalInformation": "array<string>",
    "TransportInformation": f"struct<InternationalRegulations:{_UN}>",
}


def record_type() -> T.StructType:
    """One nullable column a section; sections without typed fields are strings
    (their JSON text). Classification and the list sections hold JSON text too."""
    return T.StructType.fromDDL(", ".join(f"`{s}` {DDL.get(s, 'string')}" for s in SECTIONS))

import json

import pytest
from pyspark.sql import functions as F

from dossiermill.operators import generation, resolution

PRODUCTS = "product long, trade_name string, other_names array<string>, company_name string, address string, phone string, email string"
COMPONENTS = "product long, pos int, name string, cas string, exact double, lower double, upper double, unit string"
IDENTITIES = "cas string, outcome string, iupac_name string, formula string, cid int, mismatch boolean, source_smiles string, fallback boolean"
PROPERTIES = "product long, property string, status string, reason string, value int, level string"


def inputs(spark, n=7):
    products = [(1, "Cleaner", ["Alias"], "Acme", None, "1", None), (2, "Salt", [], "Acme", "road", None, "a@b"), (3, "Nothing", None, "Acme", None, None, None)]
    known = ["64-17-5", "67-56-1", "7647-14-5", "108-88-3"]
    components = [(1, 10 * i, f"n{i}" if i % 2 else None, known[i % 4] if i % 3 else None, None, 1.0, 2.0, "%") for i in range(n)] + [(2, 0, "salt", "7647-14-5", 100.0, None, None, " "), (2, 1, None, None, 1.0, None, None, "%"), (2, 2, "x", "12-34", 1.0, None, None, "%")]
    identities = [("64-17-5", "resolved", "ethanol", "C2H6O", 702, False, "CCO", False), ("67-56-1", "ambiguous", None, None, None, False, None, False), ("7647-14-5", "resolved", None, "ClNa", 5234, True, "[Na+].[Cl-]", True)]
    properties = [(1, p, "resolved" if n == 0 else "unresolved", None if n == 0 else "conflicting_sources" if n == 1 else "human_review_required", 5, "product_test_report" if n == 0 else None) for n, p in enumerate(resolution.POLICIES)]
    make = spark.createDataFrame
    return make(products, PRODUCTS), make(components, COMPONENTS), make(identities, IDENTITIES), make(properties, PROPERTIES)


@pytest.mark.parametrize("cell", [1_024, 30, 1])
def test_lists_have_no_gaps(spark, monkeypatch, cell):
    monkeypatch.setattr(generation, "CELL", cell)
    products, components, identities, properties = inputs(spark, 40)
    index = [(r.pos, r["index"]) for r in generation.indexed(components, identities).where("product = 1").collect()]
    assert sorted(index) == [(10 * i, i) for i in range(40)]
    rows = generation.provenance(products, components, identities, properties).orderBy("product", "ordinal").collect()
    for p in (1, 2, 3):
        own = [r for r in rows if r.product == p]
        assert [r.ordinal for r in own] == list(range(len(own)))
    first = [r.path for r in rows if r.product == 1][:5]
    assert first == [*(generation.PRODUCT_FIELDS[c] for c in ("trade_name", "other_names", "company_name", "phone")), f"{generation.ROWS}[0].Concentration"]
    assert [r.path.rpartition(".")[2] for r in rows if r.product == 3] == ["TradeNameJP", "CompanyName"]
    salt = [r for r in rows if r.product == 2][-1]
    assert (salt.path, salt.source_reference) == (generation.SOURCE_SMILES, "PubChem CID 5234") and salt.warning
    assert [r.path for r in rows if r.confidence == "high"] == ["PhysicalChemicalProperties.FlashPoint"]


def test_ambiguity_replaces_a_missing_identity(spark):
    rows = generation.unresolved(*inputs(spark)).orderBy("product", "ordinal").collect()
    at = lambda i: f"{generation.ROWS}[{i}].{generation.CAS_NO}"
    got = [(r.path, r.reason, r.blocks_release) for r in rows if r.product == 1]
    assert len({p for p, _, _ in got}) == len(got) and [r.ordinal for r in rows if r.product == 1] == list(range(len(got)))
    # 1 and 5 are ambiguous and come last; 4 is resolved, 2 too; no number at 0, 3 and 6
    assert got[-2:] == [(at(1), "ambiguous_chemical_identity", True), (at(5), "ambiguous_chemical_identity", True)]
    assert got[0][1:] == ("conflicting_sources", True) and len(got) == 8
    assert not [r for r in rows if r.product != 1]


def test_upsert_keeps_the_last_writer(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1, "x"), (1, "b", 0, 2, "y"), (1, "a", 1, 0, "z"), (2, "a", 0, 0, None)], "doc int, path string, writer int, n int, value string")
    got = {(r.doc, r.path): (r.writer, r.value) for r in generation.upserted(rows, "doc", "path", ["writer", "n"]).collect()}
    assert got == {(1, "a"): (1, "z"), (1, "b"): (0, "y"), (2, "a"): (0, None)}
    assert generation.upserted(rows.where("doc > 9"), "doc", "path", ["writer", "n"]).count() == 0


def test_drafts(spark):
    products, components, identities, _ = inputs(spark, 3)
    got = {r.product: json.loads(r.j) for r in generation.drafts(products, components, identities).select("product", F.to_json(F.struct("Identification", "Composition")).alias("j")).collect()}
    assert got[3] == {"Identification": {"TradeProductIdentity": {"TradeNameJP": "Nothing"}, "SupplierInformation": {"CompanyName": "Acme"}}}
    none, methanol, salt = got[1]["Composition"]["CompositionAndConcentration"]
    assert none == {"Concentration": {"NumericRangeWithUnitAndQualifier": {"LowerValue": {"Value": 1.0}, "UpperValue": {"Value": 2.0}, "Unit": "%"}}}
    assert methanol["SubstanceIdentifiers"] == {"SubstanceNames": {"GenericName": "n1"}, "SubstanceIdentity": {"CASno": {"FullText": ["67-56-1"]}}} and "MolecularFormula" not in methanol
    assert "MolecularFormula" not in salt  # its structure says otherwise
    assert "Unit" not in got[2]["Composition"]["CompositionAndConcentration"][0]["Concentration"]["NumericRangeWithUnitAndQualifier"]
    empty = generation.drafts(products.where("product > 9"), components, identities)
    assert empty.count() == 0


def test_property_sections(spark):
    rows = [
        (1, "FlashPoint", 12.0, None, None, "degC", "closed cup", 20.0, None, None, None), (1, "ExplosiveLimits", None, None, 9.5, "%", None, None, 101.3, "air", None), (1, "SelfReactivity", None, None, None, None, None, None, None, None, "stable"),
        (2, "CorrosiveToMetals", None, None, None, None, "test C", None, None, None, "none"), (3, "VapourPressure", 3.0, None, None, "kPa", None, 20.5, None, "air", None), (4, "ExplosiveLimits", None, None, None, "%", None, None, None, None, None),
    ]
    best = spark.createDataFrame(rows, "product int, property string, value double, lower double, upper double, unit string, method string, temperature double, pressure double, atmosphere string, result string")
    got = {r.product: json.loads(r.j) for r in generation.property_sections(best).select("product", F.to_json(F.struct("HazardIdentification", "PhysicalChemicalProperties", "StabilityReactivity")).alias("j")).collect()}
    exact = lambda v, u: {"ExactValue": {"Value": v}, "Unit": u}
    assert got[1] == {
        "PhysicalChemicalProperties": {"FlashPoint": [{"NumericRangeWithUnitAndQualifier": exact(12.0, "degC"), "Method": "closed cup", "Condition": "20°C"}], "ExplosionLimit": [{"ItemName": "Upper Explosive Limit", "NumericRangeWithUnitAndQualifier": exact(9.5, "%"), "Condition": "101.3 kPa, air"}]},
        "StabilityReactivity": {"HazardousReactions": {"SelfReactivityAndExplosiveness": "stable"}},
    }
    assert got[2] == {"HazardIdentification": {"Classification": {"PhysicochemicalEffect": {"CorrosiveToMetals": "none (method: test C)"}}}}
    assert got[3]["PhysicalChemicalProperties"]["VapourPressure"] == [{"NumericRangeWithUnitAndQualifier": exact(3.0, "kPa"), "Condition": {"Temperature": 20.5, "Unit": "°C", "OtherCondition": "air"}}]
    assert got[4] == {}


def test_lists_are_numbered_before_they_are_written_out(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    products, components, identities, properties = inputs(spark)
    assert "Window" not in plan(generation.drafts(products, components, identities))
    # components are put in order once for products with few of them, and for those with many also to count cells
    assert plan(generation.provenance(products, components, identities, properties)).count("Window [row_number()") <= 3


def test_a_product_with_many_components_is_numbered_like_the_others(spark, monkeypatch):
    got = {}
    for cell in (2, 1_024):
        monkeypatch.setattr(generation, "CELL", cell)
        products, components, identities, properties = inputs(spark)
        for of in (generation.provenance, generation.unresolved):
            rows = of(products, components, identities, properties).orderBy("product", "ordinal").collect()
            assert got.setdefault(of.__name__, rows) == rows


def test_steps_are_done_once_without_large_products(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for cell, times in ((1_024, 1), (2, 3)):
        monkeypatch.setattr(generation, "CELL", cell)
        assert plan(generation.provenance(*inputs(spark))).count("Window [row_number()") == times


def test_a_component_meets_its_lookup_without_its_quantities(spark):
    plan = generation.provenance(*inputs(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Window [row_number()" in line or "Join LeftOuter, (cas" in line]
    assert len(joins) == 2 and "Join" in joins[0] and "Window" in joins[1]


def test_paths_of_open_fields_are_written_out_in_the_end(spark):
    plan = generation.unresolved(*inputs(spark))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    first = next(n for n, line in enumerate(lines) if "Window [" in line)
    assert generation.CAS_NO in "".join(lines[:first]) and generation.CAS_NO not in "".join(lines[first:])


def test_an_unknown_property_that_is_open_has_no_path(spark):
    products, components, identities, _ = inputs(spark)
    properties = spark.createDataFrame([(3, p, "unresolved", reason, None, None) for p, reason in (("Odour", "human_review_required"), ("VapourPressure", "conflicting_sources"), ("FlashPoint", "missing_input"))], PROPERTIES)
    rows = generation.unresolved(products, components, identities, properties).where("product = 3").orderBy("ordinal").collect()
    paths = generation.PROPERTY_PATHS
    assert [(r.path, r.blocks_release) for r in rows] == [(None, False), (paths["FlashPoint"], False), (paths["VapourPressure"], True)]

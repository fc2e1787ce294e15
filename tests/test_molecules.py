import pytest
from pyspark.sql import functions as F

from dossiermill.functions import molecules
from dossiermill.operators import identities


@pytest.mark.parametrize(("formula", "want"), [
    ("H2O", {"H": 2, "O": 1}), ("OH2", {"H": 2, "O": 1}), ("Ca(OH)2", {"Ca": 1, "O": 2, "H": 2}), ("[Co(NH3)6]Cl3", {"Co": 1, "N": 6, "H": 18, "Cl": 3}), ("CuSO4·5H2O", {"Cu": 1, "S": 1, "O": 9, "H": 10}),
    ("Na2CO3.10H2O", {"Na": 2, "C": 1, "O": 13, "H": 20}), ("SO4--", {"S": 1, "O": 4, "charge": -2}), ("NH4+", {"N": 1, "H": 4, "charge": 1}), ("Fe^3+", {"Fe": 1, "charge": 3}), ("SO4(2-)", {"S": 1, "O": 4, "charge": -2}),
    ("Fe+3", {"Fe": 1, "charge": 3}), ("CO", {"C": 1, "O": 1}), ("Co", {"Co": 1}), ("D2O", {"H": 2, "O": 1}), ("C₆H₆", {"C": 6, "H": 6}), ("C((CH3)2)2", {"C": 5, "H": 12}), (" ClNa ", {"Cl": 1, "Na": 1}),
])
def test_formulas(formula, want):
    assert molecules.element_counts(formula) == want


@pytest.mark.parametrize("formula", [None, "", " ", "water", "H2O)", "(H2O", "()2", "2", "C(H]2", "Xx2", "C..H", "C2H5OH plus", "h2o", "CH3-CH3", "Fe++3", "Fe+-"])
def test_no_formulas(formula):
    assert molecules.element_counts(formula) is None


@pytest.mark.parametrize(("smiles", "formula", "charge", "fragments"), [
    ("C", "CH4", 0, 1), ("CCO", "C2H6O", 0, 1), ("C=CCCl", "C3H5Cl", 0, 1), ("c1ccccc1", "C6H6", 0, 1), ("CC(=O)Oc1ccccc1C(=O)O", "C9H8O4", 0, 1), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C8H10N4O2", 0, 1),
    ("[Na+].[Cl-]", "ClNa", 0, 2), ("[NH4+]", "H4N+", 1, 1), ("[O-]S(=O)(=O)[O-]", "O4S-2", -2, 1), ("OS(=O)(=O)O", "H2O4S", 0, 1), ("C#N", "CHN", 0, 1), ("c1cc[nH]c1", "C4H5N", 0, 1), ("c1ccoc1", "C4H4O", 0, 1),
    ("c1ccsc1", "C4H4S", 0, 1), ("c1ccc2ccccc2c1", "C10H8", 0, 1), ("C1CCCCC1", "C6H12", 0, 1), ("C%10CC%10", "C3H6", 0, 1), ("C1CC1C1CC1", "C6H10", 0, 1), ("N[C@@H](C)C(=O)O", "C3H7NO2", 0, 1), ("F/C=C/F", "C2H2F2", 0, 1),
    ("[13CH4]", "CH4", 0, 1), ("[2H]O[2H]", "H2O", 0, 1), ("C[N+](=O)[O-]", "CH3NO2", 0, 1), ("CN(=O)=O", "CH3NO2", 0, 1), ("[Fe+++]", "Fe+3", 3, 1), ("[Fe+3]", "Fe+3", 3, 1), ("O=P(O)(O)O", "H3O4P", 0, 1), ("[H][H]", "H2", 0, 1),
    ("c1ccncc1", "C5H5N", 0, 1), ("Oc1ccccc1", "C6H6O", 0, 1), ("c1ccc(cc1)-c1ccccc1", "C12H10", 0, 1), ("BrC(Br)Br", "CHBr3", 0, 1), ("O.O.[Ca+2].[O-]S([O-])(=O)=O", "CaH4O6S", 0, 4),
])
def test_structures(smiles, formula, charge, fragments):
    got = molecules.structure(smiles)
    assert (got["formula"], got["charge"], got["fragments"]) == (formula, charge, fragments)


@pytest.mark.parametrize("smiles", [None, "", "C(", "C)", "C1CC", "C==C", "=C", "[C", "Xx", "C=", "(C)", "C..C", ".C", "C.", "C11", "[Qq]", "C (", "C=1CC#1"])
def test_no_structures(smiles):
    assert molecules.structure(smiles) is None


def test_weight():
    assert molecules.structure("CC(=O)Oc1ccccc1C(=O)O")["weight"] == pytest.approx(180.16, abs=0.01)
    assert molecules.structure("[U]")["weight"] is None


def test_normalized_candidates(spark):
    rows = [
        (1, "CCO", "CC", "OC2H6"), (2, None, "CC", "C2H6"), (3, None, None, "C2H6"), (4, "C(", None, "C2H6"), (5, "[Na+].[Cl-]", None, "ClNa"), (6, "CCO", None, "C3H8"), (7, "CCO", None, None), (8, "", "CC", "C2H6"), (9, "CCO", None, "ethanol"),
    ]
    df = spark.createDataFrame(rows, "cid int, smiles string, connectivity string, formula string").withColumn("cas", F.lit("x"))
    got = {r.cid: (r.structure, r.calculated, r.fragments, r.fallback, r.mismatch, r.review) for r in identities.normalized(df).collect()}
    assert got == {
        1: ("normalized", "C2H6O", 1, False, False, False), 2: ("normalized", "C2H6", 1, True, False, False), 3: ("missing", None, None, False, False, False), 4: ("invalid", None, None, False, False, False),
        5: ("normalized", "ClNa", 2, False, False, True), 6: ("normalized", "C2H6O", 1, False, True, True), 7: ("normalized", "C2H6O", 1, False, False, False), 8: ("invalid", None, None, False, False, False), 9: ("normalized", "C2H6O", 1, False, True, True),
    }
    assert identities.normalized(df.where("cid < 0")).count() == 0


def test_equivalent_formulas_are_published(spark):
    parts = spark.createDataFrame([(1, 1, "64-17-5"), (1, 2, "67-56-1")], "doc long, pos int, cas string")
    candidates = spark.createDataFrame([("64-17-5", 1, "C2H6O", "normalized", "OH6C2", 1), ("67-56-1", 2, "CH4O", "normalized", "CH3O", 1)], "cas string, cid int, formula string, structure string, calculated string, fragments int")
    errors = spark.createDataFrame([], "cas string, message string")
    got = {r.pos: (r.mismatch, r.published_formula) for r in identities.identified(parts, identities.outcomes(candidates, errors)).collect()}
    assert got == {1: (False, "C2H6O"), 2: (True, None)}

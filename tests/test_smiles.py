"""Structures with known formulas, and what is no structure."""

import pytest
from pyspark.sql import functions as F

from peakfold.functions import chem, smiles
from peakfold.functions.dims import SMILES

# Structures of known compounds.
KNOWN = {
    "CC(=O)Oc1ccccc1C(=O)O": "C9H8O4", "Cn1cnc2c1c(=O)n(C)c(=O)n2C": "C8H10N4O2", "C[C@H](N)C(=O)O": "C3H7NO2", "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O": "C6H12O6",
    "c1ccc2[nH]ccc2c1": "C8H7N", "c1ccncc1": "C5H5N", "c1ccoc1": "C4H4O", "c1ccsc1": "C4H4S", "C1CC1": "C3H6", "N": "H3N", "[NH4+].[Cl-]": "H4ClN", "C%12CCCCC%12": "C6H12", "ClC(Cl)Cl": "CHCl3",
    "CS(=O)(=O)C": "C2H6O2S", "FS(F)(F)(F)(F)F": "F6S", "C[N+](C)(C)CC(=O)[O-]": "C5H11NO2", "C/C=C\\C": "C4H8", "C#C": "C2H2", "O=C=O": "CO2", "[2H]O[2H]": "H2O", "CN(=O)=O": "CH3NO2",
    "C1=CC=CC=C1": "C6H6", "OB(O)c1ccccc1": "C6H7BO2", "CC(C)Cc1ccc(cc1)[C@@H](C)C(O)=O": "C13H18O2", "C[Se]CC[C@H](N)C(=O)O": "C5H11NO2Se", "[Fe+2]": "Fe", "c1c[se]cc1": "C4H4Se",
    "P(=O)(O)(O)O": "H3O4P", "CP": "CH5P", "C1CC=1": "C3H4", "C=1CC1": "C3H4", "[H][H]": "H2", "BrCCI": "C2H4BrI", "[CH3:7]O": "CH4O", "c1ccccc1-c1ccccc1": "C12H10", "[C@@](F)(Cl)(Br)I": "CBrClFI",
}
BROKEN = ["", "C1CC", "C(", "C)", "(C)", "C=", "=C", "C==C", "C..C", "C.", "[Xx]", "[C", "C]", "C C", "FF(F)", "CC(C)(C)(C)C", "C11", "1CC1", "C=1CC#1", "C%1", "*", "[]", "é", "C(=)C", "C(C.C)C"]


@pytest.mark.parametrize("text", BROKEN)
def test_unreadable(text):
    with pytest.raises(smiles.Unreadable):
        smiles.atoms(text)


def test_known_structures(spark):
    rows = spark.createDataFrame([(k,) for k in KNOWN] * 2 + [(None,)] + [(b,) for b in BROKEN], "smiles string").repartition(3)
    got = rows.withColumn("formula", smiles.hill(smiles.composition(F.col("smiles")))).collect()
    assert {r.smiles: r.formula for r in got} == KNOWN | {None: None} | dict.fromkeys(BROKEN)


def test_known_ones_keep_their_formulas(spark):
    rows = spark.createDataFrame([(k,) for k in [*SMILES, "C1CC1", "no structure"]], "smiles string")
    for read in (False, True):
        got = {r.smiles: r.formula for r in chem.smiles_formula(rows, read=read).collect()}
        assert got == SMILES | {"C1CC1": "C3H6" if read else "C1CC1", "no structure": "no structure"}


def test_long_structures():
    assert smiles.atoms("C" * 20_000) == {"C": 20_000, "H": 40_002}
    assert smiles.atoms("C(" * 3_000 + "O" + ")" * 3_000) == {"C": 3_000, "H": 6_002, "O": 1}

"""Adducts, formulas and isotope patterns against known values."""

import pytest
from pyspark.sql import functions as F

from peakfold.functions import chem, dims
from peakfold.operators import render

# The adducts' shifts, charges and expressions.
GOLDEN = {
    "[M+H]+": (1.006728, 1, "M + 1.006728 Da"),
    "[M+Na]+": (22.989221, 1, "M + 22.989221 Da"),
    "[M+K]+": (38.963158, 1, "M + 38.963158 Da"),
    "[M+NH4]+": (18.033826, 1, "M + 18.033826 Da"),
    "[M+H-H2O]+": (-17.003837, 1, "M - 17.003837 Da"),
    "[M+2H]2+": (2.013456, 2, "(M + 2.013456) / |2| Da"),
    "[M+3H]3+": (3.020184, 3, "(M + 3.020184) / |3| Da"),
    "[M+2Na-H]+": (44.971714, 1, "M + 44.971714 Da"),
    "[M-H]-": (-1.006728, -1, "(M - 1.006728) / |-1| Da"),
    "[M+Cl]-": (34.969401, -1, "(M + 34.969401) / |-1| Da"),
    "[M+HCOO]-": (44.998203, -1, "(M + 44.998203) / |-1| Da"),
    "[M+CH3COO]-": (59.013853, -1, "(M + 59.013853) / |-1| Da"),
    "[M-H2O-H]-": (-19.017293, -1, "(M - 19.017293) / |-1| Da"),
    "[M+Na-2H]-": (20.975765, -1, "(M + 20.975765) / |-1| Da"),
}


def test_adduct_table(spark):
    got = {r.adduct: r for r in chem.adduct_table(spark).collect()}
    assert set(got) == set(GOLDEN)
    for name, (shift, charge, offset) in GOLDEN.items():
        r = got[name]
        assert round(r.shift, 6) == shift and r.charge == charge and r.offset == offset
        assert r.polarity == ("positive" if charge > 0 else "negative")


def test_adduct_lookup(spark):
    asked = {"[m+na]+": "[M+Na]+", "[m-h]-": "[M-H]-", " [M+nh4]+ ": "[M+NH4]+", "[M+H2O]+": None, "[M+Li]+": None, "[M+2]+": None, "M+H": None, "[M]": None, "   ": None}
    got = chem.lookup_adducts(spark.createDataFrame([(a,) for a in asked], "adduct_string string")).collect()
    assert {r.adduct_string: r.canonical for r in got} == asked
    assert all(r.rejected == (r.canonical is None) for r in got)
    assert "REJECTED" in render.adduct_report(next(r for r in got if r.rejected)) and "Charge: +1" in render.adduct_report(next(r for r in got if r.canonical == "[M+Na]+"))
    for short in ("", "ab"):
        with pytest.raises(ValueError):
            chem.require_length(short, 3, "adduct")


def parsed(spark, *formulas):
    out = {}
    for r in chem.parse_formulas(spark.createDataFrame([(f,) for f in formulas], "formula string")).collect():
        out.setdefault(r.formula, {})[r.element] = r.n
    return out


def test_formula_parse(spark):
    got = parsed(spark, "C6H12O6", "H2O", "CH3CH3", "C60", "NaCl", "(CH3)2")
    assert got == {"C6H12O6": {"C": 6, "H": 12, "O": 6}, "H2O": {"H": 2, "O": 1}, "CH3CH3": {"C": 2, "H": 6}, "C60": {"C": 60}, "NaCl": {"Na": 1, "Cl": 1}, "(CH3)2": {"C": 1, "H": 3}}


def test_formula_errors(spark):
    rows = spark.createDataFrame([("CaCl2",), ("",), ("42",), ("H2O",)], "f string").select("f", chem.formula_error(F.col("f")).alias("e"))
    got = {r.f: r.e for r in rows.collect()}
    assert "Unknown element 'Ca' in formula 'CaCl2'" in got["CaCl2"] and "Could not parse any elements" in got[""] and "Could not parse" in got["42"] and got["H2O"] is None


def pattern(spark, *formulas):
    out = {}
    for r in chem.isotope_patterns(spark.createDataFrame([(f,) for f in formulas], "formula string")).collect():
        out.setdefault(r.formula, {})[r.label] = r
    return out


def test_isotopes(spark):
    # Monoisotopic masses and shares of the next isotopologues.
    mono = {"CH4": 16.031300128, "H2O": 18.010564683, "C2H6O": 46.041864811, "C6H12O6": 180.063388098, "C7H6O": 106.041864811, "C8H10N4O2": 194.080375574}
    shares = {"H2O": (0.000611, 0.002055), "C6H12O6": (0.068560, 0.014680), "C8H10N4O2": (0.103212, 0.009436), "Cl": (0.319609, 0.051075)}
    got = pattern(spark, *mono, "Cl", "CaCl2", "Fe")
    for f, m in mono.items():
        assert got[f]["M"].mass == pytest.approx(m, abs=1e-6) and got[f]["M"].abundance == 1
        assert got[f]["M+1"].mass - got[f]["M"].mass == pytest.approx(dims.NEUTRON, abs=1e-9)
        assert got[f]["M+2"].mass - got[f]["M"].mass == pytest.approx(2 * dims.NEUTRON, abs=1e-9)
    for f, (one, two) in shares.items():
        assert got[f]["M+1"].abundance == pytest.approx(one, abs=1e-5) and got[f]["M+2"].abundance == pytest.approx(two, abs=1e-5)
    assert got["CaCl2"][None].error and got["Fe"]["M+1"].abundance > 1
    text = render.isotope_report(list(got["C6H12O6"].values()))
    assert "| M | 180.0634 | 1.0000 |" in text and "0.0686" in text and render.isotope_report(list(got["CaCl2"].values())).startswith("ERROR")


def test_smiles(spark):
    got = {r.smiles: r.formula for r in chem.smiles_formula(spark.createDataFrame([(s,) for s in [*dims.SMILES, "C1CC1"]], "smiles string")).collect()}
    assert got == dims.SMILES | {"C1CC1": "C1CC1"}


def test_masses_once_a_formula(spark):
    names = ["C6H12O6", "C2H6O", "Xx2", "", None, "H2O", "C" * 30]
    rows = spark.range(3_000).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("formula"))
    found = chem.formula_masses(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Aggregate [") > plan.index("Join")  # the sums stand above a grouping of formulas
    got = {(r.id, r.formula, r.mass, r.m1, r.m2) for r in found.collect()}
    want = rows.select("id", "formula", chem.isotope_columns(F.col("formula")).alias("i")).select("id", "formula", "i.mass", "i.m1", "i.m2")
    assert got == {tuple(r) for r in want.collect()} and len(got) == 3_000

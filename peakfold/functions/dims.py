"""Small fixed tables: adducts, isotopes, diagnostic ions, structures, compounds."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Masses in Da that results depend on.
PROTON = 1.00727646688
ELECTRON = 0.00054857990907
NEUTRON = 1.00866491588
H, C, N, O = 1.007825032, 12.0, 14.003074004, 15.994914619  # noqa: E741
NA, K, CL = 22.98976928, 38.96370649, 34.96885269

# Adduct, mass shift, charge.  The proton's shift takes the electron off once more than
# physics would; results are pinned to it.
_P = PROTON - ELECTRON
ADDUCTS = [
    ("[M+H]+", _P, 1),
    ("[M+Na]+", NA - ELECTRON, 1),
    ("[M+K]+", K - ELECTRON, 1),
    ("[M+NH4]+", N + 4 * H - ELECTRON, 1),
    ("[M+H-H2O]+", _P - (2 * H + O), 1),
    ("[M+2H]2+", 2 * _P, 2),
    ("[M+3H]3+", 3 * _P, 3),
    ("[M+2Na-H]+", 2 * (NA - ELECTRON) - _P, 1),
    ("[M-H]-", -_P, -1),
    ("[M+Cl]-", CL + ELECTRON, -1),
    ("[M+HCOO]-", H + C + 2 * O + ELECTRON, -1),
    ("[M+CH3COO]-", 2 * C + 3 * H + 2 * O + ELECTRON, -1),
    ("[M-H2O-H]-", -(2 * H + O) - _P, -1),
    ("[M+Na-2H]-", (NA - ELECTRON) - 2 * _P, -1),
]

# Isotopes of each element as (mass, abundance), by ascending mass.
ISOTOPES = {
    "C": [(12.0, 0.9893), (13.003354835, 0.0107)],
    "H": [(1.007825032, 0.999885), (2.014101778, 0.000115)],
    "N": [(14.003074004, 0.99632), (15.000108898, 0.00368)],
    "O": [(15.994914619, 0.99757), (16.999131756, 0.00038), (17.999159612, 0.00205)],
    "S": [(31.972071174, 0.9493), (32.971458909, 0.0076), (33.967867004, 0.0429)],
    "Cl": [(34.96885269, 0.7578), (36.96590258, 0.2422)],
    "Br": [(78.9183376, 0.5069), (80.9162897, 0.4931)],
    "P": [(30.973761998, 1.0)],
    "F": [(18.998403163, 1.0)],
    "I": [(126.9044677, 1.0)],
    "Na": [(22.98976928, 1.0)],
    "K": [(38.96370649, 0.93258), (39.96399817, 0.00012), (40.96182526, 0.0673)],
    "Si": [(27.976926535, 0.9223), (28.976494665, 0.0467), (29.97377001, 0.031)],
    "Fe": [(53.939609, 0.05845), (55.934936, 0.91754), (56.935393, 0.02119), (57.933274, 0.00282)],
    "Se": [(73.922475934, 0.0089), (75.9192137, 0.0937), (76.9199142, 0.0763), (77.9173091, 0.2377), (79.9165218, 0.4961), (81.9167095, 0.0873)],
}

# Diagnostic ions as (bit, name, m/z).  m/z 0 stands for a heuristic, -1 for a neutral
# loss; neither is matched by mass, and they need no name.
DIAGNOSTIC_IONS = [
    (0, "Tyrosine immonium", 136.0757),
    (1, "Phenylalanine immonium", 120.0808),
    (2, "Tryptophan immonium", 159.0917),
    (3, "Histidine immonium", 110.0713),
    (4, "Arginine immonium", 129.1135),
    (5, "Proline immonium", 70.0651),
    (6, "Leu/Ile immonium", 86.0964),
    (7, "Methionine immonium", 104.0528),
    (8, None, 0.0),
    (9, None, 0.0),
    (10, None, 0.0),
    (11, None, -1.0),
    (12, None, -1.0),
    (13, None, -1.0),
    (14, "Oxonium (glycan)", 163.0601),
    (15, "Oxonium (HexNAc)", 204.0867),
]

# Structures with known formulas.
SMILES = {
    "CCO": "C2H6O",
    "c1ccccc1": "C6H6",
    "CC(=O)O": "C2H4O2",
    "C1=CC=C(C=C1)C=O": "C7H6O",
    "CN1C=NC2=C1C(=O)N(C(=O)N2C)C": "C8H10N4O2",
    "O": "H2O",
    "[Na+].[Cl-]": "NaCl",
}

#: Compounds that the views name their spectra after.
COMPOUNDS = [
    ("caffeine", "C8H10N4O2"), ("glucose", "C6H12O6"), ("cholesterol", "C27H46O"), ("testosterone", "C19H28O2"), ("adenosine", "C10H13N5O4"),
    ("cysteine", "C3H7NO2S"), ("chloroform", "CHCl3"), ("penicillin G", "C16H18N2O4S"), ("thyroxine", "C15H11I4NO4"), ("selenomethionine", "C5H11NO2Se"),
    ("ferrocene", "C10H10Fe"), ("sodium benzoate", "C7H5NaO2"), ("glyphosate", "C3H8NO5P"),
]


@cache
def _rows(name: str) -> tuple[list, str]:
    tables = {
        "adducts": ([(a, float(s), c, "positive" if c > 0 else "negative") for a, s, c in ADDUCTS], "adduct string, shift double, charge int, polarity string"),
        "isotopes": ([(e, k, m, a) for e, iso in ISOTOPES.items() for k, (m, a) in enumerate(iso)], "element string, k int, mass double, abundance double"),
        "ions": (DIAGNOSTIC_IONS, "bit int, ion string, mz double"),
        "smiles": (sorted(SMILES.items()), "smiles string, known_formula string"),
        "compounds": ([(n, a, b) for n, (a, b) in enumerate(COMPOUNDS)], "compound_id int, compound_name string, formula string"),
    }
    return tables[name]


def table(spark: SparkSession, name: str) -> DataFrame:
    """adducts, isotopes, ions, smiles or compounds as a DataFrame; tens of rows each."""
    return spark.createDataFrame(*_rows(name))


def values_sql(name: str) -> str:
    """The same table as a SQL VALUES list with a column list, to stand behind FROM."""

    def literal(x) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)

    rows, kinds = _rows(name)
    cols = ", ".join(c.split()[0] for c in kinds.split(", "))
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS {name}({cols})"

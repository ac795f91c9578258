"""The named queries over the plain tables, and for each the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem, peaks as pk
from ..functions.dims import ADDUCTS, COMPOUNDS, DIAGNOSTIC_IONS, ISOTOPES, NEUTRON, table, values_sql
from ..operators import qc, run_search, search as sr, similarity as sim, stats, summary
from ..operators.tables import materialized
from ..sources import files, views
from ..sources.views import PEAKS_SQL, SPECTRA_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _r(c: str, digits: int = 9):
    return F.round(F.col(c), digits).alias(c)


NESTED_SQL = """nested AS (
  SELECT spectrum_id, list({'mz': mz, 'x': intensity} ORDER BY mz, intensity) AS ref FROM peaks GROUP BY spectrum_id)"""
QUERY_SQL = "q AS (SELECT mz, intensity AS x, row_number() OVER (ORDER BY mz, intensity) AS o FROM peaks WHERE spectrum_id = 1)"
#: The greedy matching, one query peak a step, over all spectra at once.
MATCH_SQL = f"""{PEAKS_SQL}, {SPECTRA_SQL}, {QUERY_SQL},
refs AS (SELECT spectrum_id, mz, intensity AS x, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS i FROM peaks),
hold AS (SELECT r.spectrum_id, q.o, list({{'d': abs(r.mz - q.mz), 'i': r.i, 'x': r.x}} ORDER BY abs(r.mz - q.mz), r.i) AS near
         FROM q JOIN refs r ON r.mz >= q.mz - 0.02::DOUBLE AND r.mz <= q.mz + 0.02::DOUBLE GROUP BY r.spectrum_id, q.o),
steps AS (
  SELECT id AS spectrum_id, 0::BIGINT AS o, []::BIGINT[] AS used, 0::DOUBLE AS dot, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS n, []::BIGINT[] AS lost FROM spectra
  UNION ALL
  SELECT s.spectrum_id, s.o + 1, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.i) END,
         s.dot + CASE WHEN p IS NULL THEN 0 ELSE q.x * p.x END, s.a + CASE WHEN p IS NULL THEN 0 ELSE q.x * q.x END, s.b + CASE WHEN p IS NULL THEN 0 ELSE p.x * p.x END,
         s.n + CASE WHEN p IS NULL THEN 0 ELSE 1 END, CASE WHEN p IS NULL THEN list_append(lost, q.o) ELSE lost END
  FROM (SELECT t.*, list_filter(h.near, lambda e: NOT list_contains(t.used, e.i))[1] AS p
        FROM steps t LEFT JOIN hold h ON h.spectrum_id = t.spectrum_id AND h.o = t.o + 1) s JOIN q ON q.o = s.o + 1),
scored AS (
  SELECT spectrum_id AS id, compound_name, formula, precursor_mz, n AS n_match, lost, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE dot / (sqrt(a) * sqrt(b)) END AS score
  FROM steps JOIN spectra ON id = spectrum_id WHERE o = (SELECT count(*) FROM q))"""
MATCH_SQL = "WITH RECURSIVE " + MATCH_SQL
P_SQL = f"""{MATCH_SQL},
ranked AS (SELECT *, round(score, 9) AS s FROM scored),
sized AS (SELECT *, count(*) OVER () AS n_all FROM ranked),
pvalues AS (SELECT *, rank() OVER (ORDER BY s DESC)::DOUBLE / (1 + n_all) AS p_value FROM sized),
raws AS (SELECT *, least(p_value * n_all / count(*) OVER (ORDER BY p_value), 1.0) AS raw FROM pvalues),
tested AS (SELECT *, min(raw) OVER (ORDER BY p_value DESC) AS q_value FROM raws)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return sr.score_library(views.query(spark, d), views.library(spark, d))


# --- scans -----------------------------------------------------------------------------------------


@query("spectra_view", f"WITH {SPECTRA_SQL} SELECT * FROM spectra")
def spectra_view(spark, d):
    return views.spectra(spark, d)


@query("peaks_view", f"WITH {PEAKS_SQL} SELECT spectrum_id, count(*) AS n_peaks, round(sum(mz), 6) AS sum_mz, sum(intensity) AS sum_intensity FROM peaks GROUP BY spectrum_id")
def peaks_view(spark, d):
    return views.peaks(spark, d).groupBy("spectrum_id").agg(F.count("*").alias("n_peaks"), F.round(F.sum("mz"), 6).alias("sum_mz"), F.sum("intensity").alias("sum_intensity"))


@query(
    "library_nested_stats",
    f"""WITH {PEAKS_SQL}, {SPECTRA_SQL}
    SELECT id, compound_name, formula, precursor_mz, count(mz)::INT AS n_peaks, min(mz) AS first_mz, max(mz) AS last_mz, coalesce(sum(intensity), 0) AS total
    FROM spectra LEFT JOIN peaks ON id = spectrum_id GROUP BY ALL""",
)
def library_nested_stats(spark, d):
    p = F.col("peaks")
    return views.library(spark, d).select("id", "compound_name", "formula", "precursor_mz", F.size(p).alias("n_peaks"), F.get(p, F.lit(0))["mz"].alias("first_mz"), F.get(p, F.size(p) - 1)["mz"].alias("last_mz"), F.aggregate(p, F.lit(0.0), lambda s, x: s + x["intensity"]).alias("total"))


@query("compound_masses", None)
def compound_masses(spark, d):
    """The mass of every spectrum's compound: the same sums as a column of the distinct formulas."""
    return chem.formula_masses(views.spectra(spark, d)).select("id", "compound_name", "formula", _r("mass"), _r("m1"), _r("m2"))


@query("mgf_roundtrip", f"WITH {PEAKS_SQL}, {SPECTRA_SQL} SELECT id AS spectrum_id, precursor_mz, count(mz)::INT AS n_peaks, round(coalesce(sum(mz), 0), 6) AS sum_mz, coalesce(sum(intensity), 0) AS sum_intensity FROM spectra LEFT JOIN peaks ON id = spectrum_id GROUP BY ALL")
def mgf_roundtrip(spark, d):
    return _totals(files.roundtrip(views.library(spark, d), "mgf"))


@query("mzml_roundtrip", SQL["mgf_roundtrip"])
def mzml_roundtrip(spark, d):
    return _totals(files.roundtrip(views.library(spark, d), "mzml"))


@query("mzml_groups_roundtrip", SQL["mgf_roundtrip"])
def mzml_groups_roundtrip(spark, d):
    return _totals(files.roundtrip(views.library(spark, d), "mzml-groups"))


def _totals(rows: DataFrame) -> DataFrame:
    total = lambda f: F.aggregate("peaks", F.lit(0.0), lambda s, x: s + x[f])
    return rows.select(F.col("index").cast("bigint").alias("spectrum_id"), "precursor_mz", F.size("peaks").alias("n_peaks"), F.round(total("mz"), 6).alias("sum_mz"), total("intensity").alias("sum_intensity"))


# --- peaks of a spectrum -----------------------------------------------------------------------------


@query("noise_filter_counts", f"WITH {PEAKS_SQL} SELECT spectrum_id, count(*)::INT AS n_peaks, (count(*) FILTER (intensity >= 25))::INT AS n_kept FROM peaks GROUP BY spectrum_id")
def noise_filter_counts(spark, d):
    return views.nested(views.peaks(spark, d)).select("spectrum_id", F.size("peaks").alias("n_peaks"), F.size(pk.above_noise(F.col("peaks"), 25.0)).alias("n_kept"))


@query(
    "top_peaks_per_spectrum",
    f"""WITH {PEAKS_SQL} SELECT spectrum_id, rank, mz, intensity FROM
    (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz)::INT AS rank FROM peaks) WHERE rank <= 10""",
)
def top_peaks_per_spectrum(spark, d):
    rows = views.nested(views.peaks(spark, d)).select("spectrum_id", F.posexplode(pk.strongest(F.col("peaks"), 10)).alias("at", "p"))
    return rows.select("spectrum_id", (F.col("at") + 1).alias("rank"), "p.mz", "p.intensity")


@query("base_peak", f"WITH {PEAKS_SQL} SELECT spectrum_id, max(intensity) AS base_intensity, arg_min(mz, {{'a': -intensity, 'b': mz}}) AS base_mz FROM peaks GROUP BY spectrum_id")
def base_peak(spark, d):
    return views.nested(views.peaks(spark, d)).select("spectrum_id", pk.base_peak(F.col("peaks")).alias("b")).select("spectrum_id", F.col("b.intensity").alias("base_intensity"), F.col("b.mz").alias("base_mz"))


@query(
    "spectrum_summary",
    f"""WITH {PEAKS_SQL}, {SPECTRA_SQL}, firsts AS (SELECT id FROM spectra ORDER BY id LIMIT 50),
    kept AS (SELECT * FROM peaks WHERE intensity >= 10)
    SELECT id AS index, 2 AS ms_level, round(id * 0.5::DOUBLE, 2) AS rt,
      CASE WHEN NOT EXISTS (SELECT 1 FROM peaks p WHERE p.spectrum_id = id) THEN 'no peak data' WHEN count(mz) = 0 THEN 'all peaks below noise threshold' ELSE 'ok' END AS status,
      count(mz)::INT AS n_peaks, arg_min(mz, {{'a': -intensity, 'b': mz}}) AS base_mz, max(intensity) AS base_intensity
    FROM firsts LEFT JOIN kept ON id = spectrum_id GROUP BY id""",
)
def spectrum_summary(spark, d):
    rows = views.library(spark, d).select(F.col("id").alias("index"), F.lit(2).alias("ms_level"), F.round(F.col("id") * F.lit(0.5), 2).alias("rt"), "peaks")
    return summary.summarize_spectra(rows, 50, 10.0).drop("top_peaks")


@query(
    "peak_list_errors",
    f"""WITH {PEAKS_SQL}, numbered AS (
      SELECT spectrum_id, intensity - 3 AS x, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) - 1 AS i FROM peaks)
    SELECT spectrum_id, 'Query peak [' || i || '] has negative intensity (' || x || ')' AS error FROM (
      SELECT spectrum_id, min(i) AS i, arg_min(x, i) AS x FROM numbered WHERE x < 0 GROUP BY spectrum_id)""",
)
def peak_list_errors(spark, d):
    rows = views.nested(views.peaks(spark, d))
    low = F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] - 3).alias("intensity")))
    return rows.select("spectrum_id", pk.list_error(low, "Query").alias("error")).where("error is not null")


@query(
    "peak_formats",
    f"""WITH {PEAKS_SQL}, sums AS (SELECT spectrum_id AS id, max(mz) AS top_mz, sum(intensity) * 1234.5678123::DOUBLE AS total, count(*) AS n FROM peaks GROUP BY spectrum_id),
    texts AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'x' || n WHEN id % 3 = 1 THEN '' || n ELSE n || '.5' END AS t FROM sums)
    SELECT id, printf('%.4f', top_mz) AS mz, CASE WHEN id % 5 = 0 THEN 'N/A' ELSE printf('%.2f', id * 0.5::DOUBLE) END AS rt,
      CASE WHEN total >= 1e6 THEN printf('%.2e', total) ELSE printf('%.2f', total) END AS intensity, TRY_CAST(t AS DOUBLE) AS number, CASE WHEN id % 3 = 1 THEN t ELSE '?' END AS level, top_mz AS precursor FROM texts""",
)
def peak_formats(spark, d):
    """What reports print: m/z, minutes, intensities, numbers out of text, and the precursor that is taken where none is given."""
    sums = views.peaks(spark, d).groupBy(F.col("spectrum_id").alias("id")).agg(F.max("mz").alias("precursor"), (F.sum("intensity") * 1234.5678123).alias("total"), F.count("*").cast("string").alias("n"))
    kind = F.col("id") % 3
    rows = sums.withColumn("t", F.when(kind == 0, F.concat(F.lit("x"), "n")).when(kind == 1, F.col("n")).otherwise(F.concat("n", F.lit(".5"))))
    rt = F.when(F.col("id") % 5 != 0, F.col("id") * 0.5)
    t = F.col("t")
    return rows.select("id", pk.fmt_mz(F.col("precursor")).alias("mz"), pk.fmt_rt(rt).alias("rt"), pk.fmt_intensity(F.col("total")).alias("intensity"), pk.to_double(t).alias("number"), pk.maybe_int(t).alias("level"), "precursor")


# --- chemistry -------------------------------------------------------------------------------------

OFFSET_SQL = "CASE WHEN charge = 1 THEN t || ' Da' ELSE '(' || t || ') / |' || charge || '| Da' END"
ADDUCT_SQL = f"""adduct_rows AS (SELECT adduct, shift, charge, polarity, {OFFSET_SQL} AS "offset" FROM
  (SELECT *, 'M ' || CASE WHEN shift >= 0 THEN '+' ELSE '-' END || ' ' || printf('%.6f', abs(shift)) AS t FROM {values_sql("adducts")}))"""
#: What is asked for each spectrum: an adduct of the table as it is, in other cases, with spaces, or something that is none.
ASKED_SQL = f"""asked AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN upper(adduct) WHEN 1 THEN lower(adduct) WHEN 2 THEN '  ' || adduct || ' ' WHEN 3 THEN replace(adduct, 'M', 'M ')
  WHEN 4 THEN repeat(' ', (p_partkey % 4)::INT) WHEN 5 THEN adduct || (p_partkey % 3) ELSE adduct END AS adduct_string
  FROM part JOIN (SELECT *, row_number() OVER (ORDER BY adduct) - 1 AS place FROM adduct_rows) ON place = p_partkey % {len(ADDUCTS)})"""


@query("adduct_table", f"WITH {SPECTRA_SQL}, {ADDUCT_SQL} SELECT r.*, (SELECT count(*) FROM spectra WHERE (precursor_mz + shift) / abs(charge) BETWEEN 100 AND 1000) AS n_in_range FROM adduct_rows r")
def adduct_table(spark, d):
    """The adducts, and for how many spectra the ion would lie in the range that is scanned."""
    mz = chem.ion_mz(F.col("precursor_mz"), F.col("shift"), F.col("charge"))
    rows = views.spectra(spark, d).select("precursor_mz").crossJoin(F.broadcast(chem.adduct_table(spark)))
    return rows.groupBy("adduct", "shift", "charge", "polarity", "offset").agg(F.count_if(mz.between(100, 1000)).alias("n_in_range"))


@query(
    "adduct_lookup",
    f"""WITH {ADDUCT_SQL}, {ASKED_SQL} SELECT id, adduct_string, adduct AS canonical, shift, coalesce(charge, 0)::INT AS charge, polarity, "offset", adduct IS NULL AS rejected
    FROM asked LEFT JOIN adduct_rows ON lower(trim(adduct_string)) = lower(adduct)""",
)
def adduct_lookup(spark, d):
    key, names = F.col("p_partkey"), sorted(chem.adduct_names())
    adduct = F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))
    forms = [
        F.upper(adduct), F.lower(adduct), F.concat(F.lit("  "), adduct, F.lit(" ")), F.replace(adduct, F.lit("M"), F.lit("M ")), F.repeat(F.lit(" "), (key % 4).cast("int")),
        F.concat(adduct, (key % 3).cast("string")),
    ]
    text = adduct
    for n, form in enumerate(forms):
        text = F.when(key % 9 == n, form).otherwise(text)
    rows = chem.lookup_adducts(views.read(spark, d, "part").select(key.alias("id"), text.alias("adduct_string")))
    return rows.withColumn("charge", F.coalesce("charge", F.lit(0)))


@query("adduct_mz", f"WITH {SPECTRA_SQL}, {ADDUCT_SQL} SELECT id, adduct, round((precursor_mz + shift) / abs(charge), 9) AS mz FROM spectra, adduct_rows")
def adduct_mz(spark, d):
    rows = views.spectra(spark, d).crossJoin(F.broadcast(table(spark, "adducts")))
    return rows.select("id", "adduct", F.round(chem.ion_mz(F.col("precursor_mz"), F.col("shift"), F.col("charge")), 9).alias("mz"))


#: A formula for each spectrum: its compound's with atoms added, or with something that is no formula.
FORMULA_CASES = [("7", "'Xy' || (p_partkey % 5)"), ("11", "'(' || 'CH3' || ')2'"), ("13", "'Na'"), ("1", "'H' || (p_partkey % 20 + 1) || 'Cl'")]
NO_FORMULA = "CASE WHEN p_partkey % 34 = 0 THEN '' ELSE '' || p_partkey END"
FORMULA_EXPR = f"CASE WHEN p_partkey % 17 = 0 THEN {NO_FORMULA} ELSE formula || CASE " + " ".join(f"WHEN p_partkey % {n} = 0 THEN {x}" for n, x in FORMULA_CASES) + " END END"
TOKENS_SQL = f"""asked AS (SELECT DISTINCT trim({FORMULA_EXPR}) AS formula FROM part JOIN (SELECT * FROM {values_sql("compounds")}) ON compound_id = p_partkey % {len(COMPOUNDS)}),
tokens AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) AS digits,
  unnest(range(len(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)')))) AS o FROM asked),
unknown AS (SELECT formula, arg_min(element, o) AS element FROM tokens WHERE element NOT IN ({", ".join(f"'{e}'" for e in ISOTOPES)}) GROUP BY formula),
problems AS (
  SELECT formula, 'Unknown element ''' || element || ''' in formula ''' || formula || '''.' AS error FROM unknown
  UNION ALL SELECT formula, 'Could not parse any elements from ''' || formula || '''.' FROM asked WHERE formula NOT IN (SELECT formula FROM tokens)),
parsed AS (
  SELECT formula, element, sum(CASE WHEN digits = '' THEN 1 ELSE digits::BIGINT END)::BIGINT AS n FROM tokens WHERE formula NOT IN (SELECT formula FROM problems) GROUP BY ALL)"""


def _formulas(spark, d):
    rows = views.spectra(spark, d).withColumn("p_partkey", F.col("id"))
    return rows.select(F.expr(FORMULA_EXPR).alias("formula"))


@query("formula_parse", f"WITH {TOKENS_SQL} SELECT * FROM parsed")
def formula_parse(spark, d):
    return chem.parse_formulas(_formulas(spark, d))


@query("formula_errors", f"WITH {TOKENS_SQL} SELECT * FROM problems")
def formula_errors(spark, d):
    return _formulas(spark, d).distinct().select("formula", chem.formula_error(F.col("formula")).alias("error")).where("error is not null")


ISOTOPE_SQL = f"""iso AS (SELECT element, max(mass) FILTER (k = 0) AS mass, max(abundance) FILTER (k = 0) AS a0, max(abundance) FILTER (k = 1) AS a1,
  max(abundance) FILTER (k = 2) AS a2 FROM {values_sql("isotopes")} GROUP BY element),
sums AS (SELECT formula, sum(n * mass) AS mono, sum(n * coalesce(a1 / a0, 0)) AS p1, sum(n * coalesce(a2 / a0, 0)) AS p2 FROM parsed JOIN iso USING (element) GROUP BY formula)"""


@query(
    "isotope_pattern",
    f"""WITH {TOKENS_SQL}, {ISOTOPE_SQL}
    SELECT formula, 'M' AS label, round(mono, 9) AS mass, 1.0::DOUBLE AS abundance, NULL::VARCHAR AS error FROM sums
    UNION ALL SELECT formula, 'M+1', round(mono + {NEUTRON!r}::DOUBLE, 9), round(p1, 9), NULL FROM sums
    UNION ALL SELECT formula, 'M+2', round(mono + 2 * {NEUTRON!r}::DOUBLE, 9), round(p1 * p1 / 2 + p2, 9), NULL FROM sums
    UNION ALL SELECT formula, NULL, NULL, NULL, error FROM problems""",
)
def isotope_pattern(spark, d):
    return chem.isotope_patterns(_formulas(spark, d)).select("formula", "label", _r("mass"), _r("abundance"), "error")


PLAIN_TOKENS_SQL = TOKENS_SQL.replace(f"trim({FORMULA_EXPR})", "formula")
SQL["compound_masses"] = f"""WITH {SPECTRA_SQL}, {PLAIN_TOKENS_SQL}, {ISOTOPE_SQL}
SELECT id, compound_name, formula, round(mono, 9) AS mass, round(p1, 9) AS m1, round(p1 * p1 / 2 + p2, 9) AS m2 FROM spectra JOIN sums USING (formula)"""
STRUCTURES = ["CCO", "c1ccccc1", "O", "[Na+].[Cl-]", "C1CC1", "CC(=O)O", "N"]


@query(
    "smiles_formula",
    f"""SELECT p_partkey AS id, asked AS smiles, coalesce(known_formula, asked) AS formula
    FROM part JOIN (VALUES {', '.join(f'({n}, {s!r})' for n, s in enumerate(STRUCTURES))}) AS t(n, asked) ON n = p_partkey % {len(STRUCTURES)} LEFT JOIN (SELECT * FROM {values_sql('smiles')}) ON asked = smiles""",
)
def smiles_formula(spark, d):
    key = F.col("p_partkey")
    text = F.element_at(F.array(*[F.lit(x) for x in STRUCTURES]), (key % len(STRUCTURES) + 1).cast("int"))
    return chem.smiles_formula(views.read(spark, d, "part").select(key.alias("id"), text.alias("smiles")))


#: Middles and ends of the structures that the parts table stands for, with their atoms.
MIDDLES = [
    ("", 0, 0, 0, 0, 0), ("c1ccc(cc1)", 6, 4, 0, 0, 0), ("C(=O)N", 1, 1, 1, 1, 0), ("N1CCN(CC1)", 4, 8, 2, 0, 0), ("[C@H](N)", 1, 3, 1, 0, 0), ("S(=O)(=O)", 0, 0, 0, 2, 1),
    ("/C=C/", 2, 2, 0, 0, 0), ("c1ncc([nH]1)", 3, 2, 2, 0, 0), ("C%11CCC(CC%11)", 6, 10, 0, 0, 0), ("[13CH2]", 1, 2, 0, 0, 0), ("c1cc2ccccc2n1", 8, 5, 1, 0, 0),
]
TAILS = [
    ("O", 0, 1, 0, 1, 0, "", ""), ("N", 0, 2, 1, 0, 0, "", ""), ("C(=O)O", 1, 1, 0, 2, 0, "", ""), ("C#N", 1, 0, 1, 0, 0, "", ""), ("Cl", 0, 0, 0, 0, 0, "Cl", ""), ("[N+](=O)[O-]", 0, 0, 1, 2, 0, "", ""),
    ("OP(=O)(O)O", 0, 2, 0, 4, 0, "", "P"), ("[Si](C)(C)C", 3, 9, 0, 0, 0, "", "Si"), ("C(=O)[O-].[Na+]", 1, 0, 0, 2, 0, "", "Na"), ("S", 0, 1, 0, 0, 1, "", ""), ("C(F)(F)F", 1, 0, 0, 0, 0, "F3", ""),
]
_ROWS = lambda rows: ", ".join(f"({n}, " + ", ".join(repr(x) for x in r) + ")" for n, r in enumerate(rows))
_COUNT = lambda e: f"CASE {e} WHEN 0 THEN '' WHEN 1 THEN upper('{e}') ELSE upper('{e}') || {e} END"


def structures(spark, d) -> DataFrame:
    """id and smiles: a chain of 1 to 12 carbons, a middle and a tail for each part."""
    key = F.col("p_partkey")
    pick = lambda rows, by: F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (by % len(rows) + 1).cast("int"))
    text = F.concat(F.expr("repeat('C', cast(p_partkey % 12 + 1 as int))"), pick(MIDDLES, F.floor(key / 12)), pick(TAILS, F.floor(key / 7)))
    return views.read(spark, d, "part").select(key.alias("id"), text.alias("smiles"))


@query(
    "structure_formulas",
    f"""WITH middles(i, mid, c1, h1, n1, o1, s1) AS (VALUES {_ROWS(MIDDLES)}), tails(j, tail, c2, h2, n2, o2, s2, halogen, other) AS (VALUES {_ROWS(TAILS)}),
    counted AS (SELECT p_partkey AS id, repeat('C', (p_partkey % 12 + 1)::INT) || mid || tail AS smiles, p_partkey % 12 + 1 + c1 + c2 AS c, 2 * (p_partkey % 12 + 1) + 1 + h1 + h2 AS h, n1 + n2 AS n,
      o1 + o2 AS o, s1 + s2 AS s, halogen, other FROM part JOIN middles ON i = (p_partkey // 12) % {len(MIDDLES)} JOIN tails ON j = (p_partkey // 7) % {len(TAILS)})
    SELECT id, smiles, {_COUNT("c")} || {_COUNT("h")} || halogen || {_COUNT("n")} || CASE other WHEN 'Na' THEN 'Na' ELSE '' END || {_COUNT("o")} || CASE other WHEN 'P' THEN 'P' ELSE '' END
      || {_COUNT("s")} || CASE other WHEN 'Si' THEN 'Si' ELSE '' END AS formula FROM counted""",
)
def structure_formulas(spark, d):
    return chem.smiles_formula(structures(spark, d), read=True)


@query(
    "precursor_ppm",
    f"WITH {SPECTRA_SQL} SELECT id, round(abs(precursor_mz - e) / precursor_mz * 1e6::DOUBLE, 9) AS ppm, abs(precursor_mz - e) / precursor_mz * 1e6::DOUBLE <= 5.0::DOUBLE AS passed FROM (SELECT *, precursor_mz + (id % 21 - 10) * 0.0004::DOUBLE AS e FROM spectra)",
)
def precursor_ppm(spark, d):
    rows = views.spectra(spark, d).withColumn("e", F.col("precursor_mz") + (F.col("id") % 21 - 10) * F.lit(0.0004))
    return rows.select("id", F.round(pk.ppm_error(F.col("precursor_mz"), F.col("e")), 9).alias("ppm"), pk.ppm_ok(F.col("precursor_mz"), F.col("e")).alias("passed"))


@query("precursor_gate_counts", f"SELECT passed, count(*) AS n FROM ({SQL['precursor_ppm']}) GROUP BY passed")
def precursor_gate_counts(spark, d):
    return precursor_ppm(spark, d).groupBy("passed").agg(F.count("*").alias("n"))


# --- similarity and search ------------------------------------------------------------------------


@query("greedy_match_pairs", f"{MATCH_SQL} SELECT id, n_match, round(score, 9) AS score, len(lost)::INT AS n_unmatched FROM scored")
def greedy_match_pairs(spark, d):
    rows = sim.compare(views.library(spark, d).where(F.size("peaks") > 0).withColumnRenamed("peaks", "reference").crossJoin(F.broadcast(views.query(spark, d))))
    return rows.select("id", F.col("n_matched").alias("n_match"), _r("score"), F.size("unmatched").alias("n_unmatched"))


SQL["greedy_match_pairs"] += " WHERE id IN (SELECT spectrum_id FROM peaks)"


@query("cosine_classical", f"{MATCH_SQL} SELECT id, n_match, round(score, 9) AS score FROM scored")
def cosine_classical(spark, d):
    return _scored(spark, d).select("id", "n_match", "score")


@query(
    "unmatched_peaks_top15",
    f"""{MATCH_SQL} SELECT id, rank, mz, intensity FROM (
      SELECT id, mz, x AS intensity, row_number() OVER (PARTITION BY id ORDER BY x DESC, mz)::INT AS rank
      FROM (SELECT id, unnest(lost) AS o FROM scored) JOIN q USING (o)) WHERE rank <= 15""",
)
def unmatched_peaks_top15(spark, d):
    rows = views.library(spark, d).crossJoin(F.broadcast(views.query(spark, d)))
    rows = rows.select("id", pk.strongest(pk.greedy_match(F.col("query"), F.col("peaks"))["unmatched"], 15).alias("top"))
    return rows.select("id", F.posexplode("top").alias("at", "p")).select("id", (F.col("at") + 1).alias("rank"), "p.mz", "p.intensity")


@query("tolerance_candidates", f"WITH {PEAKS_SQL}, {QUERY_SQL} SELECT q.mz AS q_mz, q.x AS q_intensity, p.spectrum_id, p.mz, p.intensity FROM q JOIN peaks p ON p.mz BETWEEN q.mz - 0.02::DOUBLE AND q.mz + 0.02::DOUBLE")
def tolerance_candidates(spark, d):
    rows = views.peaks(spark, d)
    return sim.tolerance_candidates(rows.where("spectrum_id = 1").select(F.col("mz").alias("q_mz"), F.col("intensity").alias("q_intensity")), rows)


def _bins_sql(f: str) -> str:
    return f"bins AS (SELECT spectrum_id, least(greatest(trunc(mz / 2)::BIGINT, 0), 1023)::BIGINT AS bin, sum({f}) AS value FROM peaks GROUP BY ALL)"


def _cosine_sql(f: str) -> str:
    return f"""WITH {PEAKS_SQL}, {_bins_sql(f)}, one AS (SELECT bin, value AS v FROM bins WHERE spectrum_id = 1)
    SELECT spectrum_id, round(sum(value * coalesce(v, 0)) / (sqrt(sum(value * value)) * (SELECT sqrt(sum(v * v)) FROM one)), 6) AS score
    FROM bins LEFT JOIN one USING (bin) GROUP BY spectrum_id"""


@query("embedding_bins", f"WITH {PEAKS_SQL}, {_bins_sql('sqrt(intensity)')} SELECT spectrum_id, bin, round(value, 9) AS value FROM bins")
def embedding_bins(spark, d):
    return sim.embedding_bins(views.peaks(spark, d)).select("spectrum_id", "bin", _r("value"))


@query("embedding_cosine_nonoise_sqrt", _cosine_sql("sqrt(intensity)"))
def embedding_cosine_nonoise_sqrt(spark, d):
    return sim.histogram_cosine(1, views.peaks(spark, d), "dreams").select("spectrum_id", _r("score", 6))


@query("embedding_cosine_nonoise_log1p", _cosine_sql("ln(1 + intensity)"))
def embedding_cosine_nonoise_log1p(spark, d):
    return sim.histogram_cosine(1, views.peaks(spark, d), "lsm-ms2").select("spectrum_id", _r("score", 6))


@query("embedding_cosine_dreams")
def embedding_cosine_dreams(spark, d):
    return sr.score_library(views.query(spark, d), views.library(spark, d), "dreams").select("id", _r("score", 6))


@query("embedding_cosine_lsm")
def embedding_cosine_lsm(spark, d):
    return sr.score_library(views.query(spark, d), views.library(spark, d), "lsm-ms2").select("id", _r("score", 6))


@query(
    "vector_topk_cosine",
    """WITH one AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score
    FROM embeddings, one ORDER BY score DESC, vec_id LIMIT 20""",
)
def vector_topk_cosine(spark, d):
    rows = views.read(spark, d, "embeddings")
    first = rows.agg(F.min_by("embedding", "vec_id").alias("q"))
    return rows.crossJoin(F.broadcast(first)).select("vec_id", F.round(pk.vector_cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(20)


@query("empirical_pvalues", f"{P_SQL} SELECT id, s AS score, round(p_value, 9) AS p_value FROM tested")
def empirical_pvalues(spark, d):
    rows = materialized(_scored(spark, d), "scores")
    return stats.empirical_p(rows, rows.select("score")).select("id", "score", _r("p_value"))


@query("bh_qvalues", f"{P_SQL} SELECT id, round(p_value, 9) AS p_value, round(q_value, 9) AS q_value FROM tested")
def bh_qvalues(spark, d):
    return sr.significance(_scored(spark, d)).select("id", _r("p_value"), _r("q_value"))


@query("null_scores_bootstrap", f"{MATCH_SQL} SELECT round(score, 9) AS score, count(*) AS n FROM scored GROUP BY 1")
def null_scores_bootstrap(spark, d):
    rows = _scored(spark, d)
    return sr.bootstrap_null(rows).groupBy("score").agg(F.count("*").alias("n"))


HITS_SQL = f"""{P_SQL}, hits AS (
  SELECT id, compound_name, formula, precursor_mz, s AS score, n_match, round(p_value, 9) AS p_value,
    CASE WHEN n_all >= 2000 THEN round(q_value, 9) END AS q_value, CASE WHEN n_all >= 2000 THEN 'fdr' ELSE 'pvalue' END AS mode
  FROM tested WHERE CASE WHEN n_all >= 2000 THEN q_value ELSE p_value END <= 0.05)"""


@query("library_search_topk", f"{HITS_SQL} SELECT row_number() OVER (ORDER BY score DESC, id)::INT AS rank, * FROM hits ORDER BY score DESC, id LIMIT 20")
def library_search_topk(spark, d):
    rows = sr.search(views.query(spark, d), views.library(spark, d))
    return rows.select("rank", "id", "compound_name", "formula", "precursor_mz", _r("score"), "n_match", _r("p_value"), _r("q_value"), "mode")


@query("library_search_bootstrap", SQL["library_search_topk"])
def library_search_bootstrap(spark, d):
    """The same hits, judged by a null of as many draws from the library as it has spectra; as many, and
    each once, for every size that has no common factor with the draws' step."""
    rows = sr.search(views.query(spark, d), views.library(spark, d), null="bootstrap")
    return rows.select("rank", "id", "compound_name", "formula", "precursor_mz", _r("score"), "n_match", _r("p_value"), _r("q_value"), "mode")


@query("library_search_mode", f"{HITS_SQL} SELECT mode, count(*) AS n_hits, round(min(score), 9) AS lowest FROM hits GROUP BY mode")
def library_search_mode(spark, d):
    rows = sr.search(views.query(spark, d), views.library(spark, d), top=None)
    return rows.groupBy("mode").agg(F.count("*").alias("n_hits"), F.round(F.min("score"), 9).alias("lowest"))


#: As MATCH_SQL, for all spectra whose id is divisible by 50 as queries; a step for each query peak that has candidates.
RUN_SQL = f"""WITH RECURSIVE {PEAKS_SQL}, {SPECTRA_SQL},
qp AS (SELECT spectrum_id AS q_id, mz, intensity AS x, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS o FROM peaks WHERE spectrum_id % 50 = 0),
refs AS (SELECT spectrum_id AS id, mz, intensity AS x, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS i FROM peaks),
hold AS (SELECT q_id, r.id, o, any_value(q.x) AS x, list({{'d': abs(r.mz - q.mz), 'i': r.i, 'x': r.x}} ORDER BY abs(r.mz - q.mz), r.i) AS near
         FROM qp q JOIN refs r ON r.mz >= q.mz - 0.02::DOUBLE AND r.mz <= q.mz + 0.02::DOUBLE GROUP BY q_id, r.id, o),
numbered AS (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY o) AS k, count(*) OVER (PARTITION BY q_id, id) AS last FROM hold),
steps AS (
  SELECT DISTINCT q_id, id, last, 0::BIGINT AS k, []::BIGINT[] AS used, 0::DOUBLE AS dot, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS n FROM numbered
  UNION ALL
  SELECT q_id, id, last, k + 1, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.i) END, dot + CASE WHEN p IS NULL THEN 0 ELSE x * p.x END,
         a + CASE WHEN p IS NULL THEN 0 ELSE x * x END, b + CASE WHEN p IS NULL THEN 0 ELSE p.x * p.x END, n + CASE WHEN p IS NULL THEN 0 ELSE 1 END
  FROM (SELECT t.*, h.x, list_filter(h.near, lambda e: NOT list_contains(t.used, e.i))[1] AS p FROM steps t JOIN numbered h ON h.q_id = t.q_id AND h.id = t.id AND h.k = t.k + 1)),
pairs AS (SELECT q_id, id, n AS n_match, round(CASE WHEN a = 0 OR b = 0 THEN 0 ELSE dot / (sqrt(a) * sqrt(b)) END, 9) AS score FROM steps WHERE k = last)"""
RUN_HITS_SQL = f"""{RUN_SQL}, every AS (
  SELECT q.q_id, s.id, coalesce(score, 0) AS score, coalesce(n_match, 0) AS n_match FROM (SELECT id AS q_id FROM spectra WHERE id % 50 = 0) q CROSS JOIN spectra s LEFT JOIN pairs p ON p.q_id = q.q_id AND p.id = s.id),
ranked AS (SELECT *, rank() OVER (PARTITION BY q_id ORDER BY score DESC)::DOUBLE / (1 + count(*) OVER (PARTITION BY q_id)) AS p_value, count(*) OVER (PARTITION BY q_id) AS n_all FROM every),
raws AS (SELECT *, least(p_value * n_all / count(*) OVER (PARTITION BY q_id ORDER BY p_value), 1.0) AS raw FROM ranked),
tested AS (SELECT *, min(raw) OVER (PARTITION BY q_id ORDER BY p_value DESC) AS q_value FROM raws),
hits AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::INT AS rank FROM tested WHERE CASE WHEN n_all >= 2000 THEN q_value ELSE p_value END <= 0.05)
SELECT q_id, rank, id, score, n_match, round(p_value, 9) AS p_value, CASE WHEN n_all >= 2000 THEN round(q_value, 9) END AS q_value, CASE WHEN n_all >= 2000 THEN 'fdr' ELSE 'pvalue' END AS mode
FROM hits WHERE rank <= 20"""


def _run(spark, d):
    rows = views.library(spark, d)
    return rows.where("id % 50 = 0"), rows


@query("run_scores", f"{RUN_SQL} SELECT q_id, id, score, n_match FROM pairs")
def run_scores(spark, d):
    return run_search.score_run(*_run(spark, d))


@query("run_search_hits", RUN_HITS_SQL)
def run_search_hits(spark, d):
    rows = run_search.search_run(*_run(spark, d))
    return rows.select("q_id", "rank", "id", "score", "n_match", _r("p_value"), _r("q_value"), "mode")


# --- quality ----------------------------------------------------------------------------------------

ION_ROWS = [(b, n, m) for b, n, m in DIAGNOSTIC_IONS if m > 0]
MASK_SQL = f"""masks AS (SELECT id, ({" + ".join(f"CASE WHEN bool_or(abs(mz - {m!r}::DOUBLE) <= 0.02::DOUBLE) THEN {1 << b} ELSE 0 END" for b, _, m in ION_ROWS)})::INT AS diag_mask
  FROM spectra LEFT JOIN peaks ON id = spectrum_id GROUP BY id)"""
#: The roll-up columns over the rows of ``metrics``.
TOTALS_SQL = f"""count(*) AS n, avg(snr) AS mean_snr, median(snr) AS median_snr, count(*) FILTER (snr < 3) * 100.0::DOUBLE / count(*) AS pct_low_snr,
  count(*) FILTER (snr > 100) * 100.0::DOUBLE / count(*) AS pct_high_snr, avg(n_peaks) AS mean_peaks, median(n_peaks) AS median_peaks, stddev_pop(n_peaks) AS std_peaks,
  count(*) FILTER (n_peaks < 5) * 100.0::DOUBLE / count(*) AS pct_sparse, count(*) FILTER (n_peaks > 100) * 100.0::DOUBLE / count(*) AS pct_dense,
  count(*) FILTER (is_chimeric) AS n_chimeric, count(*) FILTER (is_chimeric) * 100.0::DOUBLE / count(*) AS pct_chimeric,
  avg(n_co_isolated) FILTER (n_co_isolated > 0) AS mean_co_isolated,
  ({" + ".join(f"CASE WHEN (count(*) FILTER (diag_mask & {1 << b} > 0))::DOUBLE / count(*) > 0.1 THEN 1 ELSE 0 END" for b, _, _ in DIAGNOSTIC_IONS)})::INT AS richness"""
METRIC_SQL = f"""{PEAKS_SQL}, {SPECTRA_SQL}, {MASK_SQL},
own AS (SELECT id, count(mz)::INT AS n_peaks, max(intensity) / quantile_cont(intensity, 0.1) AS snr FROM spectra LEFT JOIN peaks ON id = spectrum_id GROUP BY id),
co AS (SELECT a.id, (count(*) - 1)::INT AS n_co_isolated FROM spectra a JOIN spectra b ON a.run_id = b.run_id AND b.precursor_mz BETWEEN a.precursor_mz - 0.7::DOUBLE AND a.precursor_mz + 0.7::DOUBLE GROUP BY a.id),
metrics AS (SELECT id, run_id, snr, n_peaks, diag_mask, n_co_isolated > 0 AS is_chimeric, n_co_isolated FROM own JOIN masks USING (id) JOIN co USING (id) JOIN spectra USING (id)),
totals AS (SELECT {TOTALS_SQL} FROM metrics)"""
POINTS_SQL = """(CASE WHEN pct_low_snr > 20 THEN -1 ELSE 2 END + CASE WHEN pct_chimeric > 20 THEN -2 WHEN pct_chimeric > 10 THEN 0 ELSE 2 END + CASE WHEN pct_sparse > 20 THEN -1 ELSE 0 END + CASE WHEN richness >= 4 THEN 0 ELSE 1 END)::INT AS score_classical,
      (CASE WHEN pct_low_snr > 20 THEN 2 ELSE 0 END + CASE WHEN pct_chimeric > 20 THEN 3 WHEN pct_chimeric > 10 THEN 1 ELSE 0 END + CASE WHEN pct_sparse > 20 THEN 1 ELSE 0 END + CASE WHEN richness >= 4 THEN 1 ELSE 0 END)::INT AS score_ml"""
VERDICT_SQL = "CASE WHEN score_ml > score_classical THEN 'ml' WHEN score_classical > score_ml THEN 'classical' ELSE 'hybrid' END AS recommendation"


def _metrics(spark, d):
    return qc.metrics(views.library(spark, d))


@query("qc_metrics", f"WITH {METRIC_SQL} SELECT id, round(snr, 9) AS snr, n_peaks, diag_mask, is_chimeric, n_co_isolated FROM metrics")
def qc_metrics(spark, d):
    return _metrics(spark, d).select("id", _r("snr"), "n_peaks", "diag_mask", "is_chimeric", "n_co_isolated")


@query("diagnostic_mask", f"WITH {PEAKS_SQL}, {SPECTRA_SQL}, {MASK_SQL} SELECT * FROM masks")
def diagnostic_mask(spark, d):
    return qc.diagnostic_masks(views.library(spark, d))


@query(
    "diagnostic_prevalence",
    f"""WITH {PEAKS_SQL}, {SPECTRA_SQL}, {MASK_SQL}, ions AS (SELECT bit, ion, mz FROM {values_sql("ions")} WHERE mz > 0)
    SELECT ion, bit, mz, n AS n_spectra, round(n * 100.0::DOUBLE / (SELECT count(*) FROM masks), 9) AS pct FROM (
      SELECT bit, ion, mz, (SELECT count(*) FROM masks WHERE (diag_mask >> bit) & 1 = 1) AS n FROM ions)""",
)
def diagnostic_prevalence(spark, d):
    return qc.prevalence(diagnostic_mask(spark, d)).select("ion", "bit", "mz", "n_spectra", _r("pct"))


@query("diagnostic_richness", f"WITH {METRIC_SQL} SELECT richness FROM totals")
def diagnostic_richness(spark, d):
    return qc.graded(qc.summary(_metrics(spark, d))).select("richness")


@query(
    "qc_snr",
    f"WITH {METRIC_SQL} SELECT round(mean_snr, 9) AS mean_snr, round(median_snr, 9) AS median_snr, round(pct_low_snr, 9) AS pct_low_snr, round(pct_high_snr, 9) AS pct_high_snr, CASE WHEN pct_low_snr > 30 THEN 'POOR' WHEN pct_low_snr > 10 THEN 'FAIR' ELSE 'GOOD' END AS snr_grade FROM totals",
)
def qc_snr(spark, d):
    return qc.graded(qc.summary(_metrics(spark, d))).select(_r("mean_snr"), _r("median_snr"), _r("pct_low_snr"), _r("pct_high_snr"), "snr_grade")


@query(
    "qc_peak_density",
    f"WITH {METRIC_SQL} SELECT round(mean_peaks, 9) AS mean_peaks, round(median_peaks, 9) AS median_peaks, round(std_peaks, 9) AS std_peaks, round(pct_sparse, 9) AS pct_sparse, round(pct_dense, 9) AS pct_dense, CASE WHEN pct_sparse > 20 THEN 'SPARSE' WHEN pct_dense > 20 THEN 'DENSE' ELSE 'NORMAL' END AS density_grade FROM totals",
)
def qc_peak_density(spark, d):
    return qc.graded(qc.summary(_metrics(spark, d))).select(*[_r(c) for c in ("mean_peaks", "median_peaks", "std_peaks", "pct_sparse", "pct_dense")], "density_grade")


@query(
    "qc_chimericity",
    f"WITH {METRIC_SQL} SELECT n_chimeric, round(pct_chimeric, 9) AS pct_chimeric, round(mean_co_isolated, 9) AS mean_co_isolated, CASE WHEN pct_chimeric > 25 THEN 'HIGH' WHEN pct_chimeric > 10 THEN 'MODERATE' ELSE 'LOW' END AS chimericity_grade FROM totals",
)
def qc_chimericity(spark, d):
    return qc.graded(qc.summary(_metrics(spark, d))).select("n_chimeric", _r("pct_chimeric"), _r("mean_co_isolated"), "chimericity_grade")


@query(
    "qc_route",
    f"WITH {METRIC_SQL}, points AS (SELECT {POINTS_SQL} FROM totals) SELECT *, {VERDICT_SQL} FROM points",
)
def qc_route(spark, d):
    return qc.graded(qc.summary(_metrics(spark, d))).select("score_classical", "score_ml", "recommendation")


# --- jobs ---------------------------------------------------------------------------------------------


@query("job_status_latest", "SELECT user_id AS job_id, arg_max(event_type, {'ts': ts, 'e': event_id}) AS state, max(ts) AS ts FROM events GROUP BY user_id")
def job_status_latest(spark, d):
    rows = views.read(spark, d, "events")
    return rows.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


@query("ping", "SELECT 'ok' AS status, 'peakfold 0.1.0 is ready' AS message, false AS chem_extra, (SELECT count(*) FROM part) AS n_spectra")
def ping(spark, d):
    """Whether the engine answers, and how many spectra it reaches."""
    from .. import __version__

    try:
        import rdkit  # noqa: F401

        extra = True
    except ImportError:
        extra = False
    says = [F.lit("ok").alias("status"), F.lit(f"peakfold {__version__} is ready").alias("message"), F.lit(extra).alias("chem_extra")]
    return views.spectra(spark, d).agg(F.count("*").alias("n_spectra")).select(*says, "n_spectra")

"""Adducts, formulas and isotope patterns as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import ADDUCTS, ISOTOPES, NEUTRON, table
from .peaks import let
from .smiles import composition, hill

_TOKEN = "([A-Z][a-z]?)([0-9]*)"


def require_length(values, least: int, what: str) -> None:
    for v in [values] if isinstance(values, str) else values:
        if v is None or len(v) < least:
            raise ValueError(f"{what} must have at least {least} character(s)")


def offset(shift: Column, charge: Column) -> Column:
    """The m/z offset as text.  Charges other than +1 are printed between bars, sign included."""
    term = F.concat(F.lit("M "), F.when(shift >= 0, "+").otherwise("-"), F.lit(" "), F.format_string("%.6f", F.abs(shift)))
    return F.when(charge == 1, F.concat(term, F.lit(" Da"))).otherwise(F.concat(F.lit("("), term, F.lit(") / |"), charge.cast("string"), F.lit("| Da")))


def ion_mz(mass: Column, shift: Column, charge: Column) -> Column:
    return (mass + shift) / F.abs(charge)


def adduct_table(spark) -> DataFrame:
    rows = table(spark, "adducts")
    return rows.withColumn("offset", offset(F.col("shift"), F.col("charge")))


def lookup_adducts(df: DataFrame, col: str = "adduct_string") -> DataFrame:
    """Adds canonical, shift, charge, polarity, offset and rejected.  The trimmed string is looked up as
    it is, then without regard to case; no two adducts differ by case alone.  The table is fixed and
    small, so it is broadcast."""
    known = adduct_table(df.sparkSession).withColumnRenamed("adduct", "canonical").withColumn("_lower", F.lower("canonical"))
    out = df.withColumn("_lower", F.lower(F.trim(F.col(col)))).join(F.broadcast(known), "_lower", "left").drop("_lower")
    return out.withColumn("rejected", F.col("canonical").isNull())


def smiles_formula(df: DataFrame, col: str = "smiles", read: bool = False) -> DataFrame:
    """Adds formula: that of a known structure, else, with ``read``, that of the structure as written, in
    Hill order; else the string itself."""
    known = table(df.sparkSession, "smiles").withColumnRenamed("smiles", "_known")
    out = df.join(F.broadcast(known), df[col] == F.col("_known"), "left")
    other = F.coalesce(hill(composition(F.col(col))), F.col(col)) if read else F.col(col)
    return out.withColumn("formula", F.coalesce("known_formula", other)).drop("_known", "known_formula")


def elements(formula: Column) -> Column:
    """array<struct<element, n>> of a formula's tokens in order; other characters are skipped."""
    names = F.regexp_extract_all(formula, F.lit(_TOKEN), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit(_TOKEN), F.lit(2))
    pair = lambda e, n: F.struct(e.alias("element"), F.when(n == "", F.lit(1).cast("bigint")).otherwise(n.try_cast("bigint")).alias("n"))
    return F.zip_with(names, counts, pair)


def formula_error(formula: Column) -> Column:
    """Null, or what is wrong: the first unknown element, or that there is none at all."""
    names = F.regexp_extract_all(formula, F.lit(_TOKEN), F.lit(1))
    unknown = F.filter(names, lambda e: ~e.isin(*ISOTOPES))
    quoted = F.concat(F.lit("'"), formula, F.lit("'"))
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("Unknown element '"), unknown[0], F.lit("' in formula "), quoted, F.lit(".")))
        .when(F.size(names) == 0, F.concat(F.lit("Could not parse any elements from "), quoted, F.lit(".")))
    )


def parse_formulas(df: DataFrame, col: str = "formula") -> DataFrame:
    """One row for each distinct formula without error and element: formula, element, n."""
    rows = df.select(F.trim(F.col(col)).alias("formula")).distinct().where(formula_error(F.col("formula")).isNull())
    rows = rows.select("formula", F.explode(elements(F.col("formula"))).alias("e")).select("formula", "e.element", "e.n")
    return rows.groupBy("formula", "element").agg(F.sum("n").alias("n"))


def isotope_patterns(df: DataFrame, col: str = "formula") -> DataFrame:
    """formula, label (M, M+1, M+2), mass, abundance, error; formulas with an error have one row.

    The isotopes of an element count by place, lightest first, and M+1, M+2 stand one neutron apart.
    """
    spark = df.sparkSession
    iso = table(spark, "isotopes").groupBy("element").agg(
        F.max(F.when(F.col("k") == 0, F.col("mass"))).alias("mass"),
        *[F.max(F.when(F.col("k") == k, F.col("abundance"))).alias(f"a{k}") for k in range(3)],
    )
    parts = parse_formulas(df, col).join(F.broadcast(iso), "element")
    sums = parts.groupBy("formula").agg(
        F.sum(F.col("n") * F.col("mass")).alias("mono"), F.sum(F.col("n") * F.coalesce(F.col("a1") / F.col("a0"), F.lit(0.0))).alias("p1"),
        F.sum(F.col("n") * F.coalesce(F.col("a2") / F.col("a0"), F.lit(0.0))).alias("p2"),
    )
    lines = [("M", F.col("mono"), F.lit(1.0)), ("M+1", F.col("mono") + NEUTRON, F.col("p1")), ("M+2", F.col("mono") + 2 * NEUTRON, F.col("p1") * F.col("p1") / 2 + F.col("p2"))]
    made = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), m.alias("mass"), x.alias("abundance")) for a, m, x in lines]))
    good = sums.select("formula", made.alias("p")).select("formula", "p.*", F.lit(None).cast("string").alias("error"))
    bad = df.select(F.trim(F.col(col)).alias("formula")).distinct().withColumn("error", formula_error(F.col("formula"))).where("error is not null")
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    return good.unionByName(bad.select("formula", null("label", "string"), null("mass", "double"), null("abundance", "double"), "error"))


def isotope_columns(formula: Column) -> Column:
    """struct<mass, m1, m2> of a formula: the monoisotopic mass and the abundances of M+1 and M+2 against M;
    null for a formula with an error.  The same sums as :func:`isotope_patterns`, without a join or a
    grouping, for columns of any size and for streams."""
    known = []
    for element, isotopes in ISOTOPES.items():
        first = isotopes[0][1]
        more = [isotopes[k][1] / first if k < len(isotopes) else 0.0 for k in (1, 2)]
        known += [F.lit(element), F.struct(F.lit(isotopes[0][0]).alias("mass"), F.lit(more[0]).alias("p1"), F.lit(more[1]).alias("p2"))]
    table_ = F.create_map(*known)
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0.0).alias("p1"), F.lit(0.0).alias("p2"))

    def add(acc: Column, e: Column) -> Column:
        one = F.try_element_at(table_, e["element"])
        return F.struct(*[(acc[c] + e["n"] * one[c]).alias(c) for c in ("mass", "p1", "p2")])

    def made(total: Column) -> Column:
        return F.when(total["mass"].isNotNull(), F.struct(total["mass"].alias("mass"), total["p1"].alias("m1"), (total["p1"] * total["p1"] / 2 + total["p2"]).alias("m2")))

    return F.when(formula_error(formula).isNull(), let(F.aggregate(elements(formula), start, add), made))


def formula_masses(df: DataFrame, col: str = "formula") -> DataFrame:
    """Adds mass, m1, m2 (see :func:`isotope_columns`), made once for each distinct formula."""
    known = df.select(F.col(col).alias("_formula")).distinct().withColumn("_i", isotope_columns(F.col("_formula")))
    known = known.select("_formula", "_i.*").where("mass is not null")
    return df.join(known, df[col] == F.col("_formula"), "left").drop("_formula")


def adduct_names() -> list[str]:
    return [a for a, _, _ in ADDUCTS]

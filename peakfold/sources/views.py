"""Spectra derived from plain tables, with arithmetic that any engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import COMPOUNDS, table, values_sql
from ..functions.peaks import PEAK


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spectrum_id, mz, intensity."""
    line = read(spark, sf_dir, "lineitem")
    whole = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 400) * F.lit(0.5)
    part = ((F.col("l_suppkey") + F.col("l_linenumber")) % 9 - 4) * F.lit(0.005)
    return line.select(F.col("l_partkey").alias("spectrum_id"), (F.lit(50.0) + whole + part).alias("mz"), F.col("l_quantity").alias("intensity"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, compound_name, formula, precursor_mz, run_id."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        key.alias("id"), (key % len(COMPOUNDS)).cast("int").alias("compound_id"), (F.lit(100.0) + ((key * key * 31 + key * 7919) % 20011) / F.lit(10.0)).alias("precursor_mz"),
        (key % 40).alias("run_id"),
    )
    return rows.join(F.broadcast(table(spark, "compounds")), "compound_id").select("id", "compound_name", "formula", "precursor_mz", "run_id")


def nested(rows: DataFrame) -> DataFrame:
    """spectrum_id, peaks: each spectrum's peaks by m/z, then intensity."""
    return rows.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectra with their peaks; one without peaks has an empty list."""
    own = nested(peaks(spark, sf_dir))
    # merged where the grouping has put them: broadcast, the lists would all be scored by the few tasks that read the headers
    rows = spectra(spark, sf_dir).join(own.hint("merge"), F.col("id") == F.col("spectrum_id"), "left").drop("spectrum_id")
    return rows.withColumn("peaks", F.coalesce("peaks", F.array().cast(f"array<{PEAK}>")))


def query(spark: SparkSession, sf_dir: str, spectrum_id: int = 1) -> DataFrame:
    """One row: the peaks of one spectrum."""
    return nested(peaks(spark, sf_dir).where(F.col("spectrum_id") == spectrum_id)).select(F.col("peaks").alias("query"))


PEAKS_SQL = """peaks AS (
  SELECT l_partkey AS spectrum_id, 50.0::DOUBLE + ((l_orderkey * 31 + l_linenumber * 17) % 400) * 0.5::DOUBLE
         + ((l_suppkey + l_linenumber) % 9 - 4) * 0.005::DOUBLE AS mz, l_quantity AS intensity
  FROM lineitem)"""
SPECTRA_SQL = f"""spectra AS (
  SELECT p_partkey AS id, compound_name, formula, 100.0::DOUBLE + ((p_partkey * p_partkey * 31 + p_partkey * 7919) % 20011) / 10.0::DOUBLE AS precursor_mz,
         p_partkey % 40 AS run_id
  FROM part JOIN (SELECT * FROM {values_sql("compounds")}) ON compound_id = p_partkey % {len(COMPOUNDS)})"""

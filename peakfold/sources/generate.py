"""Synthetic spectra for trials: JVM expressions over ``range``, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import table
from ..functions.peaks import PEAK


def uniform(seed: int, *keys: Column) -> Column:
    """A number in 0..1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(6.283185307179586 * uniform(seed + 1, *keys))


def peak_list(key: Column, n: Column, precursor: Column, seed: int = 0) -> Column:
    """``n`` fragments below 95 % of the precursor, by m/z, and the precursor itself near the end."""

    def fragment(i: Column) -> Column:
        mz = 50 + uniform(seed, key, i) * (precursor * 0.95 - 50)
        return F.struct(F.bround(mz, 4).alias("mz"), F.bround(-500 * F.log(1 - uniform(seed + 2, key, i)) * (0.5 + 1.5 * uniform(seed + 3, key, i)), 2).alias("intensity"))

    last = F.struct(F.bround(precursor + 0.2 * uniform(seed + 4, key) - 0.1, 4).alias("mz"), F.bround(100 + 900 * uniform(seed + 5, key), 2).alias("intensity"))
    return F.concat(F.array_sort(F.transform(F.sequence(F.lit(1), n), fragment)), F.array(last)).cast(f"array<{PEAK}>")


def library(spark: SparkSession, n_spectra: int = 2500, seed: int = 42) -> DataFrame:
    """id, compound_name, formula, precursor_mz, run_id, peaks: 9 to 41 peaks a spectrum."""
    pool = table(spark, "compounds")
    size = pool.count()
    rows = spark.range(1, n_spectra + 1).select("id", F.floor(uniform(seed, F.col("id")) * size).cast("int").alias("compound_id"))
    precursor = F.bround(150 + 700 * uniform(seed + 10, F.col("compound_id")) + 0.05 * normal(seed + 11, F.col("id")), 4)
    rows = rows.withColumn("precursor_mz", precursor).join(F.broadcast(pool), "compound_id")
    n = (8 + F.floor(33 * uniform(seed + 20, F.col("id")))).cast("int")
    return rows.select("id", "compound_name", "formula", "precursor_mz", (F.col("id") % 40).alias("run_id"), peak_list(F.col("id"), n, F.col("precursor_mz"), seed + 30).alias("peaks"))


def spectrum(spark: SparkSession, seed: int = 0) -> DataFrame:
    """One query spectrum of 16 to 51 peaks: query."""
    precursor, n = 180 + 720 * uniform(seed, F.lit(1)), (15 + F.floor(36 * uniform(seed + 1, F.lit(1)))).cast("int")
    return spark.range(1).select(peak_list(F.lit(0), n, precursor, seed + 2).alias("query"))

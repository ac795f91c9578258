"""The tools by name, from call to text."""

import time

import pytest

from peakfold import tools
from peakfold.functions import peaks as pk
from peakfold.operators.jobs import Jobs
from peakfold.sources import files, generate
from pyspark.sql import functions as F


def test_texts(spark, tmp_path):
    assert tools.ping(spark).first().status == "ok"
    assert "M + 22.989221 Da" in tools.predict_adduct_offset(spark, "[m+na]+") and "REJECTED" in tools.predict_adduct_offset(spark, "   ")
    assert "46.0419" in tools.annotate_isotopes(spark, "CCO", True) and "Unknown element 'Ca'" in tools.annotate_isotopes(spark, "CaCl2")
    assert "PASSED" in tools.validate_precursor(100, 100.0004)
    peaks = [(100.0, 50.0), (200.0, 100.0)]
    assert "1.0000" in tools.compute_cosine(spark, peaks, peaks) and "1.0000" in tools.compute_cosine(spark, peaks, peaks, scoring_method="lsm-ms2")
    assert "ERROR" in tools.compute_cosine(spark, [], peaks) and "vendor" in tools.load_mzml_summary(spark, "x.raw")
    for call in (lambda: tools.predict_adduct_offset(spark, "ab"), lambda: tools.annotate_isotopes(spark, ""), lambda: tools.compute_cosine(spark, peaks, peaks, scoring_method="other")):
        with pytest.raises(ValueError):
            call()


def test_generated_library_through_search_and_quality(spark, tmp_path):
    rows = generate.library(spark, 120)
    again = generate.library(spark, 120)
    assert rows.exceptAll(again).isEmpty() and rows.count() == 120
    sizes = rows.agg(F.min(F.size("peaks")).alias("lo"), F.max(F.size("peaks")).alias("hi")).first()
    assert 9 <= sizes.lo <= sizes.hi <= 41
    assert "Recommendation" in tools.generate_qc_summary(rows)
    jobs = Jobs(spark, str(tmp_path))
    job = tools.search_library(jobs, generate.spectrum(spark, 3), rows)
    for _ in range(240):
        text = tools.check_search_status(jobs, job)
        if "Library" in text or "failed" in text:
            break
        time.sleep(0.5)
    assert "Library" in text
    assert "no job" in tools.check_search_status(jobs, "00000000-0000-0000-0000-000000000000")
    files.write_mgf(rows.select(F.col("id").cast("int").alias("index"), F.lit(1.0).alias("rt"), "precursor_mz", "peaks"), str(tmp_path / "x.mgf"))
    assert "Spectrum #1 " in tools.load_mzml_summary(spark, str(tmp_path / "x.mgf"))


def test_formats(spark):
    row = spark.createDataFrame([(1.5, None, "7", "x", 2e6)], "a double, b double, c string, d string, e double")
    got = row.select(pk.fmt_mz(F.col("a")), pk.fmt_rt(F.col("a")), pk.fmt_rt(F.col("b")), pk.maybe_int(F.col("c")), pk.maybe_int(F.col("d")), pk.fmt_intensity(F.col("e")), pk.to_double(F.col("d"))).first()
    assert tuple(got) == ("1.5000", "1.50", "N/A", "7", "?", "2.00e+06", None)

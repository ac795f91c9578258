"""Statistics, search, quality, jobs, files, streams."""

import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.operators import qc, render, search, stats, summary
from peakfold.operators.jobs import CANCELLED, COMPLETED, FAILED, RUNNING, Jobs
from peakfold.sources import files
from peakfold.streaming import watch

LIST = "array<struct<mz:double,intensity:double>>"


def test_benjamini_hochberg(spark):
    r = random.Random(4)
    p = [round(r.random(), 3) for _ in range(500)] + [1.0, 0.0, 0.0]
    order = sorted(range(len(p)), key=lambda i: p[i])
    q = [0.0] * len(p)
    for rank, i in enumerate(order, 1):
        q[i] = min(p[i] * len(p) / rank, 1.0)
    for a, b in zip(order[-2::-1], order[:0:-1]):
        q[a] = min(q[a], q[b])
    got = {x.id: x.q_value for x in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id int, p_value double")).collect()}
    assert all(got[i] == pytest.approx(v, abs=1e-12) for i, v in enumerate(q)) and len(got) == len(p)


def test_empirical_p(spark):
    r = random.Random(5)
    s, null = [round(r.random(), 2) for _ in range(200)], [round(r.random(), 2) for _ in range(300)]
    got = {x.id: x.p_value for x in stats.empirical_p(spark.createDataFrame(list(enumerate(s)), "id int, score double"), spark.createDataFrame([(x,) for x in null], "score double")).collect()}
    assert all(got[i] == pytest.approx((1 + sum(x > v for x in null)) / (1 + len(null))) for i, v in enumerate(s))


def library(spark, n):
    r = random.Random(6)
    rows = [(i, f"c{i}", "H2O", 100.0 + i, i % 3, [(float(r.randint(50, 90)), float(r.randint(1, 50))) for _ in range(r.randint(0, 12))]) for i in range(n)]
    return spark.createDataFrame(rows, f"id long, compound_name string, formula string, precursor_mz double, run_id long, peaks {LIST}"), rows


@pytest.mark.parametrize("method", ["classical", "dreams"])
def test_search(spark, method):
    rows, raw = library(spark, 120)
    query = spark.createDataFrame([([(60.0, 5.0), (61.0, 7.0), (75.0, 2.0)],)], f"query {LIST}")
    got = search.search(query, rows, method, small=100).collect()
    assert len(got) <= 20 and [x["rank"] for x in got] == list(range(1, len(got) + 1)) and all(x.mode == "fdr" and x.q_value <= 0.05 for x in got)
    assert [(-x.score, x.id) for x in got] == sorted((-x.score, x.id) for x in got)
    small = search.search(query, rows, method)
    assert all(x.mode == "pvalue" and x.q_value is None and x.p_value <= 0.05 for x in small.collect())
    assert "WARNING" in render.hits_report(small, 120)
    scores = {x.id: x.score for x in search.score_library(query, rows, method).collect()}
    assert len(scores) == 120 and all(scores[i] == 0 for i, *_, p in raw if not p)


def test_quality(spark):
    rows, raw = library(spark, 90)
    got = {x.id: x for x in qc.metrics(rows).collect()}
    for i, _, _, mz, run, peaks in raw:
        assert got[i].n_co_isolated == sum(a != i and run == b and mz - 0.7 <= m <= mz + 0.7 for a, _, _, m, b, _ in raw)
        x = [p[1] for p in peaks]
        assert got[i].snr == (pytest.approx(max(x) / np.percentile(x, 10)) if x else None) and got[i].n_peaks == len(x)
    one = qc.graded(qc.summary(qc.metrics(rows))).first()
    assert "Recommendation" in render.qc_report(one) and one.n_spectra == 90 and one.std_peaks == pytest.approx(np.std([len(p) for *_, p in raw]))


@pytest.mark.parametrize(
    ("low", "chimeric", "sparse", "rich", "want"),
    [(20, 10, 20, 3, (5, 0)), (20.01, 10, 20, 3, (2, 2)), (20, 10.01, 20, 3, (3, 1)), (20, 20.01, 20, 3, (1, 3)), (20, 10, 20.01, 4, (3, 2)), (50, 50, 50, 5, (-4, 7))],
)
def test_route(spark, low, chimeric, sparse, rich, want):
    row = qc.route(spark.createDataFrame([(float(low), float(chimeric), float(sparse), rich)], "pct_low_snr double, pct_chimeric double, pct_sparse double, richness int")).first()
    assert (row.score_classical, row.score_ml) == want
    assert row.recommendation == ("ml" if want[1] > want[0] else "classical" if want[0] > want[1] else "hybrid")


@pytest.mark.parametrize(("value", "grade"), [(10.0, "GOOD"), (10.1, "FAIR"), (30.0, "FAIR"), (30.1, "POOR")])
def test_grades(spark, value, grade):
    made = qc.summary(qc.metrics(library(spark, 5)[0])).withColumn("pct_low_snr", F.lit(value))
    assert qc.graded(made).first().snr_grade == grade


def test_co_isolation_across_blocks(spark):
    rows = [(n, 0, round(69.0 + n * 0.25, 2)) for n in range(20)]
    got = {x.id: x.n_co_isolated for x in qc.co_isolated(spark.createDataFrame(rows, "id long, run_id long, precursor_mz double")).collect()}
    assert got == {i: sum(j != i and m - 0.7 <= k <= m + 0.7 for j, _, k in rows) for i, _, m in rows}


def test_jobs(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path))
    assert jobs.status(str(uuid.uuid4()))["state"] == "UNKNOWN" and jobs.status("not-a-uuid")["state"] == "UNKNOWN"
    good = jobs.dispatch(lambda: spark.range(5), "range")
    bad = jobs.dispatch(lambda: spark.range(1).select(F.raise_error(F.lit("no luck"))))
    for _ in range(240):
        if {jobs.status(good)["state"], jobs.status(bad)["state"]} == {COMPLETED, FAILED}:
            break
        time.sleep(0.5)
    assert jobs.result(good).count() == 5 and "no luck" in jobs.status(bad)["error"]
    assert Jobs(spark, str(tmp_path)).status(good)["state"] == COMPLETED
    with pytest.raises(ValueError):
        jobs.result(bad)


def test_cancelled_jobs(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path), threads=1)
    slow = jobs.dispatch(lambda: spark.range(0, 2, 1, 2).select(F.udf(lambda _: time.sleep(60))("id").alias("x")), "slow")
    late = jobs.dispatch(lambda: spark.range(1), "late")
    for _ in range(120):
        if jobs.status(slow)["state"] == RUNNING:
            break
        time.sleep(0.25)
    time.sleep(2)
    for job in (late, slow):
        jobs.cancel(job)
    for job in (slow, late):
        jobs.wait(job, 50)
    assert jobs.status(slow)["state"] == jobs.status(late)["state"] == CANCELLED and "cancelled" in jobs.status(late)["message"]


def test_null_draws_with_gaps(spark):
    rows = [(n * n + 5, n / 100) for n in range(100)]
    got = sorted(r.score for r in search.bootstrap_null(spark.createDataFrame(rows, "id long, score double")).collect())
    assert got == sorted(rows[(n * 7919 + 13) % 100][1] for n in range(100))


def test_reports_give_method_and_reasons(spark):
    rows, _ = library(spark, 40)
    query = spark.createDataFrame([([(60.0, 5.0), (61.0, 7.0)],)], f"query {LIST}")
    assert "matched greedily" in render.hits_report(search.search(query, rows), 40, method="classical") and "dreams" in render.scoring("dreams")
    text = render.qc_report(qc.graded(qc.summary(qc.metrics(rows))).first())
    assert "because" in text and "136.076" in text


def test_path_guards(tmp_path):
    assert "Unsupported vendor format '.raw'" in files.check_path("x.RAW") and ".d" in files.check_path("x.d")
    assert "Unrecognised" in files.check_path("x.txt") and "not found" in files.check_path(str(tmp_path / "x.mgf"))
    (tmp_path / "x.mzML").write_text("")
    assert files.check_path(str(tmp_path / "x.mzML")) is None


@pytest.mark.parametrize("kind", ["mgf", "mzml"])
def test_files(spark, tmp_path, kind):
    rows = [(0, 2, 1.5, 181.07, [(50.125, 3.0), (60.5, 1e7)]), (1, 2, 0.0, 300.0, [])]
    path = str(tmp_path / f"own.{kind}")
    (files.write_mgf if kind == "mgf" else files.write_mzml)(spark.createDataFrame(rows, f"index int, ms_level int, rt double, precursor_mz double, peaks {LIST}"), path)
    got = sorted(files.read_spectra(spark, path).collect())
    assert [(r["index"], r.ms_level, r.rt, r.precursor_mz, [tuple(p) for p in r.peaks]) for r in got] == rows
    text = render.spectra_report(summary.summarize_spectra(files.read_spectra(spark, path), 5, 0.0), path, 5)
    assert "(no peak data)" in text and "base peak 60.5000 (1.00e+07)" in text
    with pytest.raises(ValueError):
        summary.summarize_spectra(files.read_spectra(spark, path), 51)


def test_mgf_of_other_writers(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\r\nTITLE=x 1\r\nPEPMASS=445.12 1000\r\nSCANS=7\r\nRTINSECONDS=90\r\n100.1 5\r\n200.2\t6 1+\r\nEND IONS\r\n\r\nBEGIN IONS\nPEPMASS=1\nEND IONS\n")
    got = sorted(files.read_spectra(spark, str(tmp_path / "a.mgf")).collect(), key=lambda r: r.precursor_mz)
    assert got[1]["index"] == 7 and got[1].rt == 1.5 and got[1].precursor_mz == 445.12 and [tuple(p) for p in got[1].peaks] == [(100.1, 5.0), (200.2, 6.0)] and got[0].peaks == []


def test_stream(spark, tmp_path):
    rows, _ = library(spark, 30)
    files.write_mgf(rows.select(F.col("id").cast("int").alias("index"), F.lit(0.0).alias("rt"), "precursor_mz", "peaks"), str(tmp_path / "in.mgf"))
    query = spark.createDataFrame([([(60.0, 5.0), (61.0, 7.0)],)], f"query {LIST}")
    watch.score_stream(query, watch.watch_mgf(spark, str(tmp_path / "in.mgf")), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    got = {r["index"]: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.score for r in search.score_library(query, rows).collect()}

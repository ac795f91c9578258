"""Matching, cosines, ppm, embeddings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.functions import embed, peaks as pk
from peakfold.operators import render, similarity

LIST = "array<struct<mz:double,intensity:double>>"


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), f"id int, query {LIST}, reference {LIST}")


def match(spark, q, r, tol):
    got = similarity.compare(pairs(spark, (0, q, r)), tolerance=tol).first()
    return got


def brute(q, r, tol):
    r = sorted(r)
    used, a, b, lost = set(), [], [], []
    for mz, x in q:
        near = [(abs(m - mz), i) for i, (m, _) in enumerate(r) if mz - tol <= m <= mz + tol and i not in used]
        if near:
            i = min(near)[1]
            used.add(i)
            a.append(x)
            b.append(r[i][1])
        else:
            lost.append((mz, x))
    a, b = np.array(a), np.array(b)
    norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return (float((a * b).sum() / norm) if len(a) and norm else 0.0), len(a), lost


# Peak lists at and beside the ends of the tolerance, and how many match.
@pytest.mark.parametrize(
    ("q", "r", "tol", "n"),
    [
        ([(101.0, 1.0)], [(100.0, 1.0)], 1.0, 1),
        ([(99.0, 1.0)], [(100.0, 1.0)], 1.0, 1),
        ([(101.1, 1.0)], [(100.0, 1.0)], 1.0, 0),
        ([(98.899999, 1.0)], [(100.0, 1.0)], 1.0, 0),
        ([(100.01, 5.0), (100.02, 6.0)], [(100.0, 10.0)], 0.1, 1),
        ([(100.0, 1.0)], [(99.9, 2.0), (100.05, 3.0)], 0.2, 1),
        ([(100.0, 1.0), (100.0, 2.0)], [(100.0, 10.0), (99.95, 20.0)], 0.1, 2),
        ([(200.0, 2.0), (100.0, 1.0)], [(100.0, 1.0), (200.0, 2.0)], 0.02, 2),
    ],
)
def test_greedy(spark, q, r, tol, n):
    got = match(spark, q, r, tol)
    score, m, lost = brute(q, r, tol)
    assert got.n_matched == n == m and got.score == pytest.approx(score) and [tuple(p) for p in got.unmatched] == lost


def test_greedy_on_random_lists(spark):
    r = random.Random(3)
    peaks = lambda: [(round(r.uniform(100, 104), 2), float(r.randint(0, 9))) for _ in range(r.randint(1, 40))]
    rows = [(n, peaks(), peaks()) for n in range(60)]
    got = {x.id: x for x in similarity.compare(pairs(spark, *rows), tolerance=0.05).collect()}
    for n, q, ref in rows:
        score, m, lost = brute(q, ref, 0.05)
        assert got[n].n_matched == m and got[n].score == pytest.approx(score, abs=1e-12) and [tuple(p) for p in got[n].unmatched] == lost


def test_reports_and_errors(spark):
    rows = [(0, [(100.0, 50.0), (200.0, 100.0), (999.0, 10.0)], [(100.0, 50.0), (200.0, 100.0)]), (1, [(100.0, -1.0)], [(1.0, 1.0)]), (2, [], [(1.0, 1.0)])]
    got = sorted(similarity.compare(pairs(spark, *rows)).collect())
    text = render.cosine_report(got[0])
    assert "Matched 2 / 3" in text and "66.7" in text and "999.0000" in text
    assert got[1].error == "Query peak [0] has negative intensity (-1.0)" and "empty" in got[2].error and render.cosine_report(got[1]).startswith("ERROR")
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            similarity.compare(pairs(spark, rows[0]), tolerance=bad)
    with pytest.raises(ValueError):
        similarity.compare(pairs(spark, rows[0]), "Classical")


def test_vector_cosine(spark):
    cases = [([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 0.9746318462), ([1.0, 0.0], [1.0, 1.0], 0.7071067812), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([2.0, 4.0], [1.0, 2.0], 1.0)]
    rows = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(cases)], "n int, a array<double>, b array<double>")
    for r in rows.select("n", pk.vector_cosine(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == pytest.approx(cases[r.n][2], abs=1e-9)


# Masses at and beside the limit of five parts in a million.
@pytest.mark.parametrize(("t", "e", "ok"), [(1e6, 999995.0, True), (1e6, 1000005.0, True), (1e6, 999994.999, False), (1e6, 1000005.001, False), (100.0, 100.0004, True), (100.0, 100.0006, False)])
def test_ppm(spark, t, e, ok):
    assert spark.createDataFrame([(t, e)], "t double, e double").select(pk.ppm_ok(F.col("t"), F.col("e")).alias("ok")).first().ok is ok
    assert ("PASSED" in render.ppm_report(t, e)) is ok


def test_ppm_needs_positive_masses():
    with pytest.raises(ValueError):
        render.ppm_report(0, 1)


PEPTIDE = [(110.0713, 40.0), (120.0808, 100.0), (136.0757, 60.0), (175.1190, 80.0), (223.1077, 30.0)]


@pytest.mark.parametrize("method", ["dreams", "lsm-ms2"])
def test_embedder(method):
    e = embed.get_embedder(method)
    v = e.embed(PEPTIDE)
    assert v.shape == (1024,) and v.dtype == np.float32 and abs(float(np.linalg.norm(v.astype(float))) - 1) < 1e-6
    assert (e.embed(PEPTIDE[::-1]) == v).all() and (e.embed(PEPTIDE, 500.0) != v).any()
    more, apart = e.embed([*PEPTIDE, (500.1, 55.0), (700.2, 45.0)]), e.embed([(900.1, 90.0), (950.2, 70.0)])
    assert float(v @ more) > 0.5 and abs(float(v @ apart)) < 1e-6
    for bad in ([], [1, 2], [[1, 2, 3]]):
        with pytest.raises(ValueError):
            e.embed(bad)


def test_embedding_compare(spark):
    same, other = PEPTIDE, [(900.1, 90.0), (950.2, 70.0)]
    got = sorted(similarity.compare(pairs(spark, (0, same, same), (1, same, other), (2, same, [])), "dreams").collect())
    assert got[0].score == pytest.approx(1, abs=1e-6) and got[1].score == pytest.approx(0, abs=1e-6) and got[2].score is None and got[2].error
    with pytest.raises(ValueError, match="dreams, lsm-ms2"):
        embed.get_embedder("other")


def test_band_join_is_exact(spark):
    r = random.Random(1)
    q = [(round(r.uniform(50, 60), 2), 1.0) for _ in range(40)]
    p = [(n, round(r.uniform(50, 60), 2), 1.0) for n in range(400)]
    got = similarity.tolerance_candidates(spark.createDataFrame(q, "q_mz double, q_intensity double"), spark.createDataFrame(p, "spectrum_id int, mz double, intensity double"), 0.02, 0.5).count()
    assert got == sum(a - 0.02 <= m <= a + 0.02 for a, _ in q for _, m, _ in p)


def test_noise_and_base_peak(spark):
    row = spark.createDataFrame([([(1.0, 5.0), (2.0, 9.0), (3.0, 9.0), (4.0, float("nan"))],)], f"peaks {LIST}")
    got = row.select(pk.above_noise(F.col("peaks"), 6.0).alias("a"), pk.above_noise(F.col("peaks"), 0.0).alias("all"), pk.base_peak(F.filter("peaks", lambda p: ~F.isnan(p["intensity"]))).alias("b"), pk.strongest(F.slice("peaks", 1, 3), 2).alias("s")).first()
    assert [p.mz for p in got.a] == [2.0, 3.0] and len(got.all) == 4 and got.b.mz == 2.0 and [p.mz for p in got.s] == [2.0, 3.0]

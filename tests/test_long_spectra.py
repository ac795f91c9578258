"""Greedy matching of long peak lists against the plain definition."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from peakfold.functions.peaks import PEAK, greedy_match, halving

SIDES = f"k int, query array<{PEAK}>, reference array<{PEAK}>"


def plain(query, reference, tol=0.02):
    ref, used = sorted(p for p in reference if None not in p), set()
    dot = a = b = n = 0
    lost = []
    for mz, x in (p for p in query if None not in p):
        near = [(abs(m - mz), i) for i, (m, _) in enumerate(ref) if mz - tol <= m <= mz + tol and i not in used]
        if near:
            i = min(near)[1]
            used.add(i)
            dot, a, b, n = dot + x * ref[i][1], a + x * x, b + ref[i][1] ** 2, n + 1
        else:
            lost.append((mz, x))
    return (dot / (math.sqrt(a) * math.sqrt(b)) if a and b else 0.0), n, lost


def crowd(r, n, width):
    return [(round(100 + r.random() * width, 3), float(r.randint(1, 99))) for _ in range(n)]


def test_equal_to_the_plain_version(spark):
    r = random.Random(8)
    rows = []
    for k in range(60):
        q, ref = crowd(r, r.choice([0, 1, 2, 30, 70]), r.choice([0.05, 1, 300])), crowd(r, r.choice([0, 1, 3, 64, 65]), r.choice([0.05, 1, 300]))
        rows.append((k, sorted(q) if k % 2 else q, ref))
    rows.append((60, [(None, 1.0), (100.0, 2.0), (100.0, None)], [(100.01, 3.0), (None, 1.0), (99.99, 3.0)]))
    got = {x.k: x.m for x in spark.createDataFrame(rows, SIDES).select("k", greedy_match(F.col("query"), F.col("reference")).alias("m")).collect()}
    for k, q, ref in rows:
        score, n, lost = plain(q, ref)
        assert got[k].score == pytest.approx(score, abs=1e-12) and got[k].n == n and [(p.mz, p.intensity) for p in got[k].unmatched] == lost


@pytest.mark.parametrize("ordered", [True, False])
def test_five_thousand_peaks(spark, ordered):
    r = random.Random(9)
    q, ref = crowd(r, 5_000, 1_500), crowd(r, 5_000, 1_500)
    df = spark.createDataFrame([(1, sorted(q) if ordered else q, ref)], SIDES)
    began = time.time()
    got = df.select(greedy_match(F.col("query"), F.col("reference")).alias("m")).first().m
    took = time.time() - began
    score, n, lost = plain(sorted(q) if ordered else q, ref)
    assert got.score == pytest.approx(score, abs=1e-12) and got.n == n and len(got.unmatched) == len(lost)
    assert took < 30


def test_steps(spark):
    rows = spark.range(1, 300).select("id", halving(F.col("id").cast("int")).alias("s")).collect()
    assert all(sum(x.s) >= x.id and x.s == sorted(x.s, reverse=True) and x.s[0] <= x.id for x in rows)

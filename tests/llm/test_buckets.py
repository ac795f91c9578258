"""Ranges of ids, also where there are many, and where one id has many rows."""

from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from peakfold.llm.common import NO_ID, bucket_of, ranged


@pytest.mark.parametrize("n", [40, 600])
def test_bounds_place_large_ids_and_ties(spark, n):
    base = 1 << 62
    bounds = [(NO_ID, -7), (NO_ID, 9), *((base + 3 * i, 5) for i in range(n)), *((base + 3 * n, t) for t in (-4, 0, 6))]
    rows = [(NO_ID, t) for t in (-8, -7, 3, 9, 10)] + [(i, t) for i in (-5, 0, *range(base - 2, base + 3 * n + 4)) for t in (-9, -4, 1, 6, 70)]
    once = {i for i, _ in bounds if sum(i == j for j, _ in bounds) == 1}
    full = [(i, -(1 << 63)) if i in once else (i, t) for i, t in bounds]
    got = spark.createDataFrame(rows, "id long, tie long").coalesce(1).select("id", "tie", bucket_of(F.col("id"), F.col("tie"), bounds).alias("b")).collect()
    assert [(r.id, r.tie, r.b) for r in got] == [(i, t, bisect_right(full, (i, t))) for i, t in rows]


def test_ranges_have_about_equal_bytes(spark):
    rows = [(None, f"without an id {n} " * 5) for n in range(400)] + [(7, f"one id {n} " * 9) for n in range(400)] + [(1000 + n, f"{n} " * 20) for n in range(1000)] + [(5000, "long " * 4000)]
    out, parts = ranged(spark.createDataFrame(rows, "doc_id long, text string"), 4_000)
    got = out.groupBy("bucket").agg(F.sum(F.octet_length("text") + 64).alias("size"), F.min(F.struct("id", "tie")).alias("a"), F.max(F.struct("id", "tie")).alias("b")).orderBy("bucket").collect()
    assert parts > 30 and sum(r["size"] for r in got) == sum(len(t) + 64 for _, t in rows)
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(got, got[1:]))
    assert sorted(r["size"] for r in got)[-2] < 30_000  # but for the long text

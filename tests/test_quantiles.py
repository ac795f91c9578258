"""Exact quantiles against sorted lists, in rounds and at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.operators.quantiles import exact_quantile


def plain(values, q):
    return float(np.quantile(values, q)) if values else None


@pytest.mark.parametrize("few, q", [(3, 0.5), (3, 0.9), (3, 1.0), (100_000, 0.0), (100_000, 0.5)])
def test_groups_of_every_kind(spark, few, q):
    r = random.Random(2)
    kinds = {
        "distinct": [r.random() for _ in range(900)], "few": [float(r.randint(0, 4)) for _ in range(800)], "heavy": [10.0 ** r.randint(-300, 300) for _ in range(500)],
        "one": [7.5], "two": [1.0, 4.0], "same": [2.0] * 300, "hot": [3.0] * 400 + [r.random() * 9 for _ in range(399)], None: [-5.0, 0.0, 11.0, 12.0],
    }
    rows = [(k, v) for k, vs in kinds.items() for v in vs] + [("distinct", None), ("none", None)]
    r.shuffle(rows)
    got = {x["k"]: (x["n"], x["quantile"]) for x in exact_quantile(spark.createDataFrame(rows, "k string, v double"), "v", q, ("k",), few).collect()}
    assert set(got) == set(kinds)
    for k, vs in kinds.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(plain(vs, q), rel=1e-12), k


@pytest.mark.parametrize("few", [5, 100_000])
def test_all_rows(spark, few):
    df = spark.range(10_001).select((F.col("id") * 7919 % 10_007).alias("v"))
    values = [r["v"] for r in df.collect()]
    assert exact_quantile(df, "v", few=few).first()["quantile"] == pytest.approx(plain(values, 0.5))
    assert tuple(exact_quantile(df.where("v < 0"), "v", few=few).first()) == (0, None)


def test_no_median_in_the_summary_plan(spark):
    from peakfold.operators import qc

    rows = spark.createDataFrame([(float(i), i % 9, 0, False, 0) for i in range(50)], "snr double, n_peaks int, diag_mask int, is_chimeric boolean, n_co_isolated int")
    one = qc.summary(rows)
    assert "median(" not in one._jdf.queryExecution().toString()
    assert (one.first()["median_snr"], one.first()["median_peaks"]) == (24.5, 4.0)


def test_bad_share(spark):
    with pytest.raises(ValueError):
        exact_quantile(spark.range(3), "id", 1.5)

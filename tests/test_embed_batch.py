"""Embedding by batch: the vectors of one by one, failures apart, embedders that are plugged in."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.functions import embed
from peakfold.functions.peaks import PEAK


def plain(made, peaks):
    """The recipe, spectrum by spectrum."""
    p = np.asarray(sorted(peaks), np.float64)
    seed = hashlib.blake2b(made.salt + struct.pack("<d", p[:, 0].max()) + p[:256].astype("<f8").tobytes(), digest_size=8).digest()
    out = np.zeros(1024)
    for mz, x in p:
        out[min(max(int(mz / 2), 0), 1023)] += made.compress(x)
    out *= 1 + np.random.default_rng(int.from_bytes(seed, "little")).normal(0, 0.05, 1024)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


@pytest.mark.parametrize("method", ["dreams", "lsm-ms2"])
def test_equal_to_one_by_one(spark, method):
    r, made = random.Random(4), embed.get_embedder(method)
    rows = [(n, [(r.choice([-3.0, 40.0 + r.random() * 900, 5_000.0, 100.0]), float(r.randint(0, 50))) for _ in range(r.choice([1, 2, 30, 400]))]) for n in range(120)]
    rows += [(200, []), (201, None), (202, [(1.0, 0.0)]), (203, [(None, 1.0), (2.0, 3.0)]), (204, [(5.0, None)])]
    df = spark.createDataFrame(rows, f"n int, peaks array<{PEAK}>").coalesce(1)
    got = {x.n: x.e for x in df.select("n", embed.embedding(method)("peaks").alias("e")).collect()}
    for n, peaks in rows[:120]:
        assert got[n].error is None and np.abs(np.array(got[n].vector) - plain(made, peaks)).max() < 1e-6
        assert (np.array(got[n].vector, np.float32) == made.embed(peaks)).all()
    assert all("embedding failed" in got[n].error and got[n].vector is None for n in (200, 201, 203, 204))
    assert got[202].error is None and not any(got[202].vector)


def test_failures_stay_apart_in_plugged_embedders(spark):
    class Own(embed.Embedder):
        def embed(self, peaks, precursor_mz=None):
            if len(peaks) == 2:
                raise RuntimeError("no model for two peaks")
            return np.full(embed.DIM, len(peaks), np.float32)

    made = Own("own", b"", np.sqrt, F.sqrt)
    vectors, errors = made.embed_batch(np.array([0, 1, 3, 6]), np.arange(6.0), np.arange(6.0))
    assert errors == [None, "no model for two peaks", None] and vectors[:, 0].tolist() == [1, 0, 3]


def test_no_rows(spark):
    df = spark.createDataFrame([], f"peaks array<{PEAK}>")
    assert df.select(embed.embedding("dreams")("peaks").alias("e")).collect() == []


def test_cosines_without_vectors(spark):
    r = random.Random(5)
    rows = [(n, [(40.0 + r.random() * 900, float(r.randint(0, 50))) for _ in range(30)]) for n in range(50)] + [(90, []), (91, None), (92, [(1.0, 0.0)]), (93, [(None, 1.0)])]
    df = spark.createDataFrame(rows, f"n int, peaks array<{PEAK}>")
    one = embed.get_embedder("dreams").embed(rows[0][1])
    got = {x.n: x.s for x in df.select("n", embed.cosine_to("dreams", one.tolist())("peaks").alias("s")).collect()}
    for n, peaks in rows[:50]:
        assert got[n] == pytest.approx(float(plain(embed.get_embedder("dreams"), peaks) @ one), abs=1e-6)
    assert [got[n] for n in (90, 91, 92, 93)] == [0, 0, 0, 0]
    assert set(x.s for x in df.select(embed.cosine_to("dreams", None)("peaks").alias("s")).collect()) == {0}

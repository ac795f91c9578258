"""Spectrum embeddings: a histogram over 1,024 m/z bins, with or without seeded noise."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 1_000  # spectra of which vectors are made at once
_EMBEDDED = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
DIM, WIDTH, SIGMA, SEED_PEAKS = 1024, 2.0, 0.05, 256


@dataclass(frozen=True)
class Embedder:
    """The contract of a pluggable embedder: a name and ``embed(peaks, precursor)`` to 1,024 floats.  One
    that overrides ``embed`` alone is called spectrum by spectrum; this one makes a batch at once."""

    name: str
    salt: bytes
    compress: Callable
    column: Callable[[Column], Column]

    def embed(self, peaks, precursor_mz: float | None = None) -> np.ndarray:
        """A unit vector that depends on the set of peaks and the precursor (by default the largest m/z)."""
        p = np.asarray(peaks, np.float64)
        if p.ndim != 2 or p.shape[1] != 2 or not len(p):
            raise ValueError(f"peaks must be a non-empty (N, 2) array, got shape {p.shape}")
        precursor = None if precursor_mz is None else np.array([precursor_mz], np.float64)
        return self._made(np.array([0, len(p)]), p[:, 0], p[:, 1], precursor)[0]

    def embed_batch(self, offsets: np.ndarray, mz: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
        """The vectors of spectra whose peaks lie one after the other, and of each what is wrong, or null.
        A spectrum that fails has zeros; it does not touch the others."""
        n = len(offsets) - 1
        vectors, errors = np.zeros((n, DIM), np.float32), [None] * n
        if type(self).embed is not Embedder.embed:
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                try:
                    vectors[i] = self.embed(np.stack([mz[a:b], x[a:b]], axis=1))
                except Exception as e:
                    errors[i] = str(e)
            return vectors, errors
        size = np.diff(offsets)
        for i in np.flatnonzero(size == 0).tolist():
            errors[i] = "peaks must be a non-empty (N, 2) array, got shape (0,)"
        good = np.flatnonzero(size)
        if len(good):
            vectors[good] = self._made(np.append(offsets[:-1][good], offsets[-1]), mz, x, None)
        return vectors, errors

    def _made(self, offsets, mz, x, precursor) -> np.ndarray:
        """Vectors of spectra with at least one peak each: one sort, one scatter-add and one norm for all;
        only the seeded noise is drawn for each."""
        n, size = len(offsets) - 1, np.diff(offsets)
        row = np.repeat(np.arange(n), size)
        if precursor is None:
            precursor = np.maximum.reduceat(mz, offsets[:-1] - offsets[0])
        order = np.lexsort((x, mz, row))
        mz, x = mz[order], x[order]
        bins = np.clip((mz / WIDTH).astype(np.int64), 0, DIM - 1)
        made = np.bincount(row * DIM + bins, self.compress(x), n * DIM).reshape(n, DIM)
        pairs = np.stack([mz, x], axis=1).astype("<f8")
        starts, noise = np.cumsum(size) - size, np.empty(DIM)
        for i, (a, b) in enumerate(zip(starts.tolist(), np.minimum(size, SEED_PEAKS).tolist())):
            seed = hashlib.blake2b(self.salt + struct.pack("<d", precursor[i]) + pairs[a : a + b].tobytes(), digest_size=8).digest()
            np.random.default_rng(int.from_bytes(seed, "little")).standard_normal(out=noise)
            made[i] *= 1 + SIGMA * noise
        norm = np.linalg.norm(made, axis=1, keepdims=True)
        return np.divide(made, norm, out=made, where=norm > 0).astype(np.float32)


EMBEDDERS = {
    "dreams": Embedder("DreaMS", b"peakfold/dreams/v1", np.sqrt, F.sqrt),
    "lsm-ms2": Embedder("LSM-MS2", b"peakfold/lsm-ms2/v1", np.log1p, F.log1p),
}


def get_embedder(method: str) -> Embedder:
    if method not in EMBEDDERS:
        raise ValueError(f"unknown embedding method {method!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[method]


def embedding(method: str):
    """An Arrow-batched function of a peaks column: struct<vector array<float>, error string>.  A
    spectrum that cannot be embedded has the error; the others are not harmed."""
    return F.arrow_udf(_embedder(get_embedder(method)), _EMBEDDED)


def _embedder(made: Embedder):
    def embed(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([_embedded(made, col.slice(at, ROWS)) for at in range(0, max(len(col), 1), ROWS)])

    return embed


def cosine_to(method: str, vector: list[float] | None):
    """An Arrow-batched function of a peaks column: the cosine of each embedding with one vector; 0 for a
    spectrum that cannot be embedded and for zero norms.  No embedding leaves the worker."""
    made = get_embedder(method)
    one = np.zeros(DIM) if vector is None else np.asarray(vector, np.float64)

    def cosine(col: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for at in range(0, len(col), ROWS):
            vectors = _vectors(made, col.slice(at, ROWS))[0].astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(one)
            out.append(np.divide(vectors @ one, norms, out=np.zeros(len(norms)), where=norms > 0))
        return pa.array(np.concatenate(out))

    return F.arrow_udf(cosine, T.DoubleType())


def _vectors(made: Embedder, col: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Vectors and errors of one stretch of a batch, from the list's offsets and flat values; a spectrum
    that fails has zeros."""
    peaks, size = col.flatten(), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(size)])
    mz, x = (pc.struct_field(peaks, i) for i in range(2))
    holes = np.asarray(pc.or_(mz.is_null(), x.is_null()).to_numpy(zero_copy_only=False), np.int64)
    broken = np.add.reduceat(np.append(holes, 0), np.minimum(offsets[:-1], len(holes))) * (size > 0) > 0 if len(size) else np.zeros(0, bool)
    values = [pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False) for v in (mz, x)]
    if broken.any():  # spectra with a missing number go before the batch is made
        stays = ~np.repeat(broken, size)
        values, offsets = [v[stays] for v in values], np.concatenate([[0], np.cumsum(np.where(broken, 0, size))])
    vectors, errors = made.embed_batch(offsets, *values)
    for i in np.flatnonzero(broken).tolist():
        errors[i] = "a peak lacks its m/z or intensity"
    for i in np.flatnonzero(~np.asarray(col.is_valid())).tolist():
        errors[i] = "there is no peak list"
    vectors[[i for i, e in enumerate(errors) if e is not None]] = 0
    return vectors, errors


def _embedded(made: Embedder, col: pa.Array) -> pa.Array:
    vectors, errors = _vectors(made, col)
    failed = np.array([e is not None for e in errors], bool)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(failed, 0, DIM))]), pa.int32()), pa.array(vectors[~failed].ravel()), mask=pa.array(failed))
    text = pa.array([None if e is None else f"ERROR: {made.name} embedding failed: {e}" for e in errors], pa.string())
    return pa.StructArray.from_arrays([lists, text], ["vector", "error"])

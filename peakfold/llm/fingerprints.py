"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, documents, ranged, small_batches
from .textops import mixed, row_shingles

EMPTY = np.uint64((1 << 64) - 1)
#: Text of one range of ids, about, while a document meets the next one.
RANGE_BYTES = 16 << 20
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bin_minima(hashes: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One permutation: each row's smallest hash in each of ``bins`` equal parts of the hash range."""
    rows = len(at) - 1
    out = np.full(rows * bins, EMPTY, np.uint64)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    part = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, row * bins + part, hashes)
    return out.reshape(rows, bins)


def densified(minima: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first full bin among a sequence that a universal hash of (bin,
    attempt) draws; rows of the same set draw alike.  Rows without any hash stay empty."""
    out, full = minima.copy(), minima != EMPTY
    bins = np.uint64(minima.shape[1])
    row, part = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 1
    while len(row):
        draw = mixed(part.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(attempt * 0x85EBCA77C2B2AE63 & (1 << 64) - 1))
        donor = ((draw >> np.uint64(32)) * bins >> np.uint64(32)).astype(np.int64)
        found = full[row, donor]
        out[row[found], part[found]] = minima[row[found], donor[found]]
        row, part = row[~found], part[~found]
        attempt += 1
    return out


def sketches(col: pa.Array, k: int, bins: int, bits: int) -> np.ndarray:
    """A row of ``bins`` numbers below 2**bits for each text; see :func:`empty_rows` for texts without words."""
    out, place = [], np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for _, _, hashes, at in row_shingles(col, k):
        for i in range(0, len(at) - 1, 1024):
            part = at[i : i + 1025]
            low = densified(bin_minima(hashes[part[0] : part[-1]], part - part[0], bins))
            none = low[:, 0] == EMPTY
            # a value's bits differ from bin to bin, or two one-shingle texts would agree in all bins or none
            low = (mixed(low + place) & np.uint64((1 << bits) - 1)).astype(np.int16)
            low[none] = -1
            out.append(low)
    return np.concatenate(out) if out else np.zeros((0, bins), np.int16)


def likeness(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Jaccard estimates of rows of sketches, corrected for the low bits that agree by chance.
    Two texts without words are alike (1); one without words is like no other (0)."""
    same, chance = (a == b).mean(axis=1), 2.0**-bits
    out = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    no_a, no_b = a[:, 0] < 0, b[:, 0] < 0
    return np.where(no_a & no_b, 1.0, np.where(no_a | no_b, 0.0, out))


def packed(sketch: np.ndarray, bits: int) -> list[str]:
    """Each sketch's low bits as hex; a text without words has the empty string."""
    planes = np.unpackbits(np.clip(sketch, 0, None).astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :]
    rows = np.packbits(planes.reshape(len(sketch), -1), axis=1)
    return ["" if s[0] < 0 else r.tobytes().hex() for s, r in zip(sketch, rows)]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _walk(k: int, bins: int, bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, order); each meets the one after it.  Rows marked as next only
        are the first of the following range and close a bucket."""
        last = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids, texts, bucket, only = (part.column(x).to_pylist() for x in ("doc_id", "text", "bucket", "next_only"))
                own = sketches(part.column("text"), k, bins, bits)
                pairs = []
                for n in range(len(ids)):
                    if last is not None and last[3] == bucket[n]:
                        pairs.append((last, (ids[n], texts[n], own[n], bucket[n])))
                    last = None if only[n] else (ids[n], texts[n], own[n], bucket[n])
                if pairs:
                    yield _made(pairs, k, bins, bits)

    return rows


def _made(pairs, k: int, bins: int, bits: int) -> pa.RecordBatch:
    changed = [edited(a[1], b[1]) for a, b in pairs]
    one, two = np.array([a[2] for a, _ in pairs]), np.array([b[2] for _, b in pairs])
    other = sketches(pa.array(changed, pa.large_string()), k, bins, bits)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([sha256(x.encode()).hexdigest() for x in changed]), pa.array(packed(one, bits)), pa.array(packed(other, bits)),
            pa.array(likeness(one, other, bits)), pa.array(likeness(one, two, bits)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, next_only: the rows dealt to ranges of ids, of about equal bytes, and sorted in
    them.  Each range ends with a copy of the first row of the next one, the last with that of the first;
    only these few rows are sent twice."""
    small_batches(docs.sparkSession)
    base, parts = ranged(docs, RANGE_BYTES)
    found = base.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("first")).collect()  # a row for each range
    first = sorted((r["bucket"], r["first"]["id"], r["first"]["tie"]) for r in found)
    ends = docs.sparkSession.createDataFrame([(i, t, b, first[n - 1][0]) for n, (b, i, t) in enumerate(first)], "id long, tie long, bucket int, to int")
    heads = base.join(F.broadcast(ends), ["bucket", "id", "tie"]).dropDuplicates(["bucket"])
    heads = heads.select("id", "tie", "text", F.col("to").alias("bucket"), F.lit(True).alias("next_only"))
    every = base.withColumn("next_only", F.lit(False)).unionByName(heads)
    every = every.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "next_only", "id", "tie")
    return every.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text", "bucket", "next_only")


def fingerprinted(docs: DataFrame, k: int = 5, bins: int = 512, bits: int = 4) -> DataFrame:
    """The fingerprint of every text and of its edited text, and their likenesses.

    Shingles are runs of ``k`` lower-cased words (a shorter text is one shingle).  Null text is empty;
    a text without words has the empty fingerprint; a very long text is sketched whole, in memory of
    about 60 times its bytes.  Rows that share a doc_id follow each other by a hash of their text, rows
    that repeat too; null ids come first.  A lone row is followed by itself; columns but doc_id and text
    are left out; an empty table gives no rows.
    """
    return with_next(docs).mapInArrow(_walk(k, bins, bits), OUT)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))

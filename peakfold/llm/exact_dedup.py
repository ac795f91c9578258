"""Exact copies through a log-structured merge index of text digests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedFilter, Scratch, documents, giving_back, may_hold, small_batches, whole, without, written

MEMTABLE = 400_000  # entries of a memtable
SHARD = 400_000  # documents for each shard of the index, about
FILTER_PER_ENTRY = 10  # bits
NO_ID = -(1 << 63)  # stands for a null id, below all others
RUN = "shard int, run long, digests binary, ids binary, counts binary, filter binary"


def _run_filter(digests: np.ndarray, bits: int) -> bytes:
    """The filter of a run: the positions of its set bits (4 bytes each), or all bits where that is
    shorter, so that its size follows the run's entries and not the shard's."""
    at = np.unique(np.concatenate(list(_bits(digests, bits))))
    if 4 * len(at) < bits // 8:
        return at.astype("<u4").tobytes()
    own = np.zeros(bits, bool)
    own[at] = True
    return np.packbits(own).tobytes()


def _set_bits(data: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(data, "<u4") if len(data) < bits // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=bits))


def _bits(digests: np.ndarray, bits: int):
    x = digests.view(np.uint64)
    for odd in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9):
        h = x * np.uint64(odd)
        yield ((h ^ (h >> np.uint64(31))) * np.uint64(odd) >> np.uint64(24)) % np.uint64(bits)


def _merged(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """Sorted by digest, one entry for each: its largest id and the sum of its counts."""
    order = np.lexsort((ids, digests))
    digests, ids, counts = digests[order], ids[order], counts[order]
    ends = np.flatnonzero(np.append(digests[1:] != digests[:-1], True)[: len(digests)])
    return digests[ends], ids[ends], np.diff(np.concatenate([[0], np.cumsum(counts)[ends]]))


def _shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    return (digests.view(np.uint64) >> np.uint64(32)).astype(np.int64) * shards >> 32


def flush(shards: int, bits: int):
    """Tasks fill memtables with (digest, id) and flush each as one sorted run for every shard."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, run = [], 0, TaskContext.get().partitionId() << 24

        def out():
            nonlocal held, rows, run
            d, i = (np.concatenate(x) for x in zip(*held))
            d, i, c = _merged(d, i, np.ones(len(d), np.int64))
            # the shard is the digest's high part as an unsigned number, so a shard is one or two stretches of the run
            s = _shard_of(d, shards)
            cols = [[] for _ in range(6)]
            for shard in np.unique(s):
                own = s == shard
                for col, x in zip(cols, (int(shard), run, d[own].tobytes(), i[own].tobytes(), c[own].tobytes(), _run_filter(d[own], bits))):
                    col.append(x)
            held, rows, run = [], 0, run + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["shard", "run", "digests", "ids", "counts", "filter"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= MEMTABLE:
                yield out()
        if rows:
            yield out()

    return runs


def compact(bits: int):
    """Merge the runs of a shard.  An entry that the filters of all other runs deny is alone and passes
    by; the rest are merged.  Only entries with more than one document come out."""

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(bits, np.uint8)  # in how many runs a bit is set, 2 for more
        for f in table.column("filter").to_pylist():
            at = _set_bits(f, bits)
            seen[at] = np.minimum(seen[at] + 1, 2)
        kept = []
        for d, i, c in zip(*(table.column(x).to_pylist() for x in ("digests", "ids", "counts"))):
            d, i, c = (np.frombuffer(x, np.int64) for x in (d, i, c))
            hit = np.ones(len(d), bool)
            for at in _bits(d, bits):
                hit &= seen[at] > 1
            hit |= c > 1
            kept.append((d[hit], i[hit], c[hit]))
        d, i, c = _merged(*(np.concatenate(x) for x in zip(*kept)))
        some = c > 1
        return pa.table({"digest": d[some], "keep_id": i[some], "group_size": c[some]})

    return merge


def index(entries: DataFrame, rows: int, scratch: Scratch | None = None) -> DataFrame:
    """digest, keep_id, group_size of every digest that more than one row has.  ``entries``: digest, id."""
    shards = max(1, math.ceil(rows / SHARD))
    bits = 1 << math.ceil(math.log2(min(rows, SHARD) * FILTER_PER_ENTRY + 8))
    runs = written(entries.mapInArrow(giving_back(flush(shards, bits)), RUN), "lsm-runs", scratch)
    return runs.groupBy("shard").applyInArrow(compact(bits), "digest long, keep_id long, group_size long")


def grouped(docs: DataFrame, digest=None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, text_sha256 of every row.

    The index is over a 64-bit digest (``digest`` makes it from a column; xxhash64 by default).  Rows
    whose digest has company are verified by their bytes: they are grouped by the text itself, and
    each task reduces its copies first, so a group of any size sends one text a task.

    Equal texts form a group; null counts as empty, and a very long text is compared whole like any
    other.  Of a group, the largest doc_id is kept (a null doc_id is below all others).  Rows that repeat
    are members like others; columns but doc_id and text are left out.  An empty table gives no rows, a
    table without copies groups of one.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    make = digest or F.xxhash64
    base = docs.select("doc_id", make(text).cast("long").alias("digest"), F.sha2(text, 256).alias("text_sha256"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"))
    slim = written(base, "digests", scratch)
    rows = slim.count()
    if not rows:
        return slim.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    hits = written(index(slim.select("digest", "id"), rows, scratch), "lsm-level1", scratch)
    may = may_hold(BoundedFilter(hits.select("digest"), hits.count()))
    with_text = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), text.alias("text")).withColumn("digest", make("text").cast("long")).where(may("digest"))
    same = with_text.groupBy("digest", "text").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    same = written(same.select("digest", F.sha2("text", 256).alias("text_sha256"), "keep", "n"), "verified", scratch)
    many = max(1_000, math.ceil(rows / 1_000))  # at most 1,000 groups can be as large
    hot = same.where(F.col("n") >= many).select("digest", "text_sha256", F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n"))
    cold = same.where(F.col("n") < many).select(F.col("digest").alias("key"), F.col("text_sha256").alias("key_sha"), "keep", "n")
    out = slim.join(F.broadcast(hot), ["digest", "text_sha256"], "left")
    out = out.withColumn("key", F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.xxhash64("id")))
    out = out.withColumn("key_sha", F.when(F.col("hot_n").isNull(), F.col("text_sha256")).otherwise(F.lit("")))
    out = out.join(cold, ["key", "key_sha"], "left")
    keep = F.coalesce("hot_keep", "keep", "id")
    return out.select("doc_id", F.nullif(keep, F.lit(NO_ID)).alias("keep_id"), F.coalesce("hot_n", "n", F.lit(1).cast("long")).alias("group_size"), "text_sha256")


def exact_groups(docs: DataFrame, digest=None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256.  Rows that share text and doc_id are all kept here."""
    out = grouped(docs, digest, scratch)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, one for each text, with its columns as they are, whatever their names.
    Null counts as an empty text, null ids and repeated rows are as in :func:`grouped`; of rows that
    share text and doc_id one stays.  An empty table gives no rows."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    by = ["key", "id", "sha"]
    rows = whole(docs, key=F.xxhash64("doc_id", sha), id=F.col("doc_id"), sha=sha)
    with Scratch(docs.sparkSession) as scratch:
        found = exact_groups(docs, scratch=scratch).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
        odd = written(found.where("not kept or n > 1").withColumn("key", F.xxhash64("id", "sha")), "dropped")
    alone = without(rows, odd.select(*by), by)
    again = odd.where("kept").select(*by)
    if not again.isEmpty():  # rows that repeat with their id: one of them stays
        may = may_hold(BoundedFilter(again.select("key"), again.count()))
        same = (rows["key"] == again["key"]) & rows["id"].eqNullSafe(again["id"]) & (rows["sha"] == again["sha"])
        alone = alone.unionByName(rows.where(may("key")).join(again, same, "left_semi").dropDuplicates(by))
    return alone.select("doc.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

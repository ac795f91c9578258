"""What the operators share: reading the table, the shared folder, range bounds, bounded filters."""

from __future__ import annotations

import ctypes
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import clean as _clean
from ..operators.tables import shared_dir

#: A word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of the bounded membership filter: 4 MB at most, whatever the input's size.
FILTER_BITS = 1 << 25
_SEGMENT = 1 << 12  # bytes of a filter that travel in one row


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes of text that go to a Python worker at once, at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the batches between the JVM and Python small, as texts are long; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        now = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def let_go() -> None:
    """Give memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def giving_back(work):
    """A function over batches that gives its worker's free memory back at the end of a task.  Workers wait
    for their next task, some for one of another kind, and what they keep is taken from the executor."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            let_go()

    return run


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


#: Rows of a file of a table of short rows, about.
FILE_ROWS = 25_000


def written(df: DataFrame, name: str, scratch: "Scratch | None" = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: lineage ends here, so a lost
    executor costs a read and not the work.  The table stays until :func:`clean`, or until its
    ``scratch`` goes.  A table of at most ``rows`` short rows takes no more files than these fill."""
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
    if scratch is not None:
        scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that nothing reads once a later one is written; they go at the end of a ``with``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete the tables :func:`written` has left.  Results that read them must be stored first."""
    _clean(spark, "llm")


def lowered(col) -> "F.Column":
    """A-Z in lower case, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def crc_rest(id_col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


#: Ranges of ids, at most, whatever the input's size, and rows of the sample for each.
MOST_RANGES, PER_RANGE = 1 << 16, 20
NO_ID = -(1 << 63)  # stands for a null id, below all others


def ranged(docs: DataFrame, bytes_each: int) -> tuple[DataFrame, int]:
    """id, tie, text and bucket of every row, and the number of buckets: ranges of (id, tie), rising and of
    about ``bytes_each`` bytes of text.  Null ids are ``NO_ID``, null text is empty, and tie is a hash of
    the text, so that rows of one id, whatever their number, are in order and can be split.

    The bounds come from a sample in which a row is the likelier the longer its text; the sample and the
    bounds have a size that does not follow the input.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    size = F.octet_length("text").cast("long") + 64
    total = base.agg(F.sum(size)).first()[0] or 0
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bytes_each)))
    draw = F.pmod(F.xxhash64("id", "tie", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    bounds: list[tuple[int, int]] = []
    if total:
        some = base.where(draw * total < size * PER_RANGE * parts).select("id", "tie").toArrow().sort_by([("id", "ascending"), ("tie", "ascending")])
        cuts = some.take(np.unique(np.arange(1, parts) * some.num_rows // parts)) if some.num_rows else some
        bounds = sorted(set(zip(cuts.column("id").to_pylist(), cuts.column("tie").to_pylist())))
    return base.select("id", "tie", "text", bucket_of(F.col("id"), F.col("tie"), bounds).cast("int").alias("bucket")), parts


def bucket_of(id_col, tie, bounds: list[tuple[int, int]]):
    """The number of bounds not above (id, tie).  A bound whose id no other one has holds all rows of it."""
    ids, ties = np.array([i for i, _ in bounds], np.int64), np.array([t for _, t in bounds], np.int64)
    often = np.isin(ids, ids[1:][ids[1:] == ids[:-1]])
    if len(bounds) <= 512:
        return _searched(id_col, tie, [(i, t if o else None) for (i, t), o in zip(bounds, often.tolist())])

    def place(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
        first, out = np.searchsorted(ids, x, "left"), np.searchsorted(ids, x, "right")
        for at in np.unique(first[out - first > 1]).tolist():  # ids with several bounds
            own = (first == at) & (out - first > 1)
            out[own] = at + np.searchsorted(ties[at : out[own][0]], y[own], "right")
        return pa.array(out.astype(np.int32))

    return F.arrow_udf(place, "int")(id_col, tie)


def _searched(id_col, tie, bounds: list):
    """A balanced tree of comparisons, so that a row costs log2(bounds) of them."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        i, t = bounds[mid]
        below = id_col < i if t is None else (id_col < i) | ((id_col == i) & (tie < t))
        return F.when(below, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _filter_rows(bits: int):
    def build(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _positions(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(own, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        parts = own.reshape(-1, _SEGMENT) if len(own) >= _SEGMENT else own.reshape(1, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["segment", "bits"])

    return build


def _positions(keys: np.ndarray, bits: int):
    """Three bit positions for each 64-bit key."""
    x = keys.astype(np.int64).view(np.uint64)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        h = x * np.uint64(odd)
        h ^= h >> np.uint64(29)
        yield (h * np.uint64(odd)) >> np.uint64(32) & np.uint64(bits - 1)


class BoundedFilter:
    """A Bloom filter of fixed size over a column of 64-bit keys.

    It never misses a key; when more keys come than it was made for, it lets more other rows
    through, which costs time and no result.  Its size, not the number of keys, bounds what is
    sent to the driver and broadcast.
    """

    def __init__(self, keys: DataFrame, rows: int):
        bits = 1 << max(15, min(int(math.log2(FILTER_BITS)), math.ceil(math.log2(max(rows, 1) * 12 + 1))))
        spark = keys.sparkSession
        some = keys.mapInArrow(_filter_rows(bits), "segment int, bits binary").groupBy("segment").agg(F.collect_list("bits").alias("all"))
        parts = some.mapInArrow(_or_segments, "segment int, bits binary")
        own = np.zeros(bits // 8, np.uint8)
        for row in parts.toLocalIterator():
            at = row["segment"] * _SEGMENT
            own[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
        self.bits, self.sent = bits, spark.sparkContext.broadcast(own.tobytes())

    @classmethod
    def of(cls, spark: SparkSession, keys: np.ndarray) -> "BoundedFilter":
        """One over keys that the driver has, with ample room, of the same bound."""
        out = cls.__new__(cls)
        out.bits = 1 << max(15, min(int(math.log2(FILTER_BITS)), math.ceil(math.log2(max(len(keys), 1) * 96))))
        own = np.zeros(out.bits // 8, np.uint8)
        for at in _positions(keys, out.bits):
            np.bitwise_or.at(own, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        out.sent = spark.sparkContext.broadcast(own.tobytes())
        return out

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        own, found = np.frombuffer(self.sent.value, np.uint8), np.ones(len(keys), bool)
        for at in _positions(keys, self.bits):
            found &= (own[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _or_segments(batches):
    for batch in batches:
        out = []
        for parts in batch.column(1).to_pylist():
            own = np.frombuffer(parts[0], np.uint8).copy()
            for more in parts[1:]:
                own |= np.frombuffer(more, np.uint8)
            out.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["segment", "bits"])


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Left join to ``right``, which has each key once and in ``weight`` the number of left rows with it.

    Keys that a thousandth of all ``rows`` share, at most 1,000 of them, are broadcast, and their left
    rows are dealt by chance; the rest are joined by key, so no task gets a large group.
    """
    many = max(1_000, math.ceil(rows / 1_000))
    cols = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) >= many).select(F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in cols])
    cold = right.where(F.col(weight) < many).select(F.col(key).alias("_key"), F.lit(True).alias("_cold"), *cols)
    out = left.join(F.broadcast(hot), key, "left")
    is_hot = F.col(f"_hot_{weight}").isNotNull()
    deal, kind = F.monotonically_increasing_id(), dict(left.dtypes)[key]
    deal = {"binary": deal.cast("string").cast("binary"), "string": deal.cast("string")}.get(kind, deal)
    # a hot row's key only deals it out; the second condition keeps it from meeting a cold row
    out = out.withColumn("_deal", F.when(is_hot, deal).otherwise(F.col(key)))
    out = out.withColumn("_open", ~is_hot)
    out = out.join(cold, (F.col("_deal") == F.col("_key")) & (F.col("_open") == F.col("_cold")), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in cols])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(docs: DataFrame, **more) -> DataFrame:
    """``doc``, each row as one value, and the columns given: whatever names docs has, none clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n) for n, c in more.items()])


def without(rows: DataFrame, dropped: DataFrame, by: list[str]) -> DataFrame:
    """The rows that no row of ``dropped`` equals in the columns ``by`` (null equals null); the first of
    them is a 64-bit hash without nulls.

    A bounded filter lets all but the dropped rows (and a few others) pass where they are; only the rest
    are shuffled with their texts to be compared.
    """
    may = may_hold(BoundedFilter(dropped.select(by[0]), dropped.count()))
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(dropped[c])
    return rows.where(~may(by[0])).unionByName(rows.where(may(by[0])).join(dropped, same & (rows[by[0]] == dropped[by[0]]), "left_anti"))


def may_hold(found: BoundedFilter):
    """Whether a 64-bit column's value may be in the filter, as a function of a column."""

    def hits(keys: pa.Array) -> pa.Array:
        return pa.array(found.may_hold(keys.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(hits, "boolean")

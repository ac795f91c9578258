"""Token files: concatenated ids with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import splitter
from .common import NO_ID, documents, new_path, ranged, small_batches, written

MAGIC = b"EFTK0002"
HEAD = struct.Struct("<8sQQQB7x")  # magic, documents, ids, first doc_id, bytes of an id
PART = struct.Struct("<BQQQ")  # low bits, bytes of the lows, of the highs, of the select samples
PIECES = 300_000  # encoded pieces in each of two generations that a task remembers
#: Text of a range of ids and ids of a file, about, and documents whose bounds are selected at once.
RANGE_BYTES, FILE_IDS, STEP = 16 << 20, 8_000_000, 4_096
SAMPLE = 256  # numbers of a sequence for each select sample


class EliasFano:
    """A rising sequence of numbers in about 2 + log2(universe / n) bits each.

    The low bits are packed as they are; the high parts are a unary bit string, in which the i-th one
    stands at (high part + i).  The select samples are the places of every 256th one, as 32-bit numbers;
    :meth:`select` reads from the sample before a number to the one after it and nothing else.
    """

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.low = n, low
        self.lows, self.highs, self.samples = np.frombuffer(lows, np.uint8), np.frombuffer(highs, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def coded(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = len(values)
        low = max(0, int(values[-1] // max(n, 1)).bit_length() - 1) if n else 0
        lows = np.packbits((values[:, None] >> np.arange(low) & 1).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> low) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low, lows.tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def packed(self) -> bytes:
        return PART.pack(self.low, self.lows.nbytes, self.highs.nbytes, self.samples.nbytes) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def unpacked(cls, data, n: int, at: int) -> tuple["EliasFano", int]:
        low, *sizes = PART.unpack_from(data, at)
        at, parts = at + PART.size, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, low, *parts), at

    def select(self, i: int, j: int | None = None):
        """The i-th number, from 0, or those from the i-th on up to the j-th."""
        if j is None:
            return int(self.select(i, i + 1)[0])
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        start = int(self.samples[i // SAMPLE]) // 8
        end = int(self.samples[-(-j // SAMPLE)]) // 8 + 1 if -(-j // SAMPLE) < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[start:end], bitorder="little")) + start * 8
        # the first sampled one may have others before it in its byte
        skip = int(np.searchsorted(ones, self.samples[i // SAMPLE])) + i % SAMPLE
        number = np.arange(i, j)
        high = ones[skip : skip + j - i] - number
        bit = number[:, None] * self.low + np.arange(self.low)
        return (high << self.low) + ((self.lows[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64) << np.arange(self.low)).sum(axis=1)


def file_bytes(ids: list[bytes], doc_ids: list, wide: bool = False) -> bytes:
    """A whole file: header, document ids (first one, rising steps in Elias-Fano), boundaries in Elias-Fano, ids.

    ``ids``: each document's ids as packed numbers of 2 bytes (4 if ``wide``); ``doc_ids`` ascend.
    """
    size = 4 if wide else 2
    ends = EliasFano.coded(np.cumsum([len(x) // size for x in ids], dtype=np.int64))
    first = doc_ids[0] if doc_ids else 0
    names = EliasFano.coded(np.array(doc_ids, np.int64) - first if doc_ids else np.zeros(0, np.int64))
    return b"".join([HEAD.pack(MAGIC, len(ids), sum(map(len, ids)) // size, first & (1 << 64) - 1, size), names.packed(), ends.packed(), *ids])


class TokenFile:
    """Reads a file back: ``doc_id(i)``, ``bounds(i)`` and ``ids(i)`` of its i-th document."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_ids, first, self.size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.first = first - (1 << 64) if first >> 63 else first
        self.names, at = EliasFano.unpacked(data, self.n, HEAD.size)
        self.ends, at = EliasFano.unpacked(data, self.n, at)
        self.body = np.frombuffer(data, "<u2" if self.size == 2 else "<u4", self.n_ids, at)

    def doc_id(self, i: int) -> int:
        return self.first + self.names.select(i)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.body[start:end]

    def runs(self, step: int = STEP):
        """(doc_ids, starts, ends) of each run of ``step`` documents, selected from the sequences."""
        for i in range(0, self.n, step):
            j = min(self.n, i + step)
            ends = self.ends.select(i, j)
            yield self.names.select(i, j) + self.first, np.concatenate([[self.ends.select(i - 1) if i else 0], ends[:-1]]), ends


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    return out, [t.content for t in out.get_added_tokens_decoder().values()], {}, {}


def encode_batch(texts: list, path: str, pattern: str, end: int, wide: bool) -> list[bytes]:
    """The ids of each text and the end id, packed.

    The library's merges never cross the pieces of its byte-level splitter, so each distinct piece is
    encoded once, as a word of its own, and remembered.  The library looks for its added tokens before
    it splits, so a text that holds the string of one is encoded by it as a whole.
    """
    tokenizer, added, known, older = _tokenizer(path)
    split = splitter(pattern)
    whole = {n for n, t in enumerate(texts) if t and any(a in t for a in added)}
    pieces = [split(t) if t and n not in whole else [] for n, t in enumerate(texts)]
    new = set().union(*pieces).difference(known)
    kind = "I" if wide else "H"
    ask = []
    for p in new:
        if p in older:
            known[p] = older[p]
        else:
            ask.append(p)
    for at in range(0, len(ask), 20_000):
        part = ask[at : at + 20_000]
        got = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        ids, word = array(kind, got.ids), np.array(got.word_ids)
        cuts = np.searchsorted(word, np.arange(len(part) + 1)).tolist()
        raw, size = ids.tobytes(), ids.itemsize
        for n, p in enumerate(part):
            known[p] = raw[cuts[n] * size : cuts[n + 1] * size]
    last = array(kind, [end]).tobytes()
    out = [b"".join(map(known.__getitem__, row)) + last for row in pieces]
    for n in whole:
        out[n] = array(kind, tokenizer.encode(texts[n], add_special_tokens=False).ids).tobytes() + last
    if len(known) > PIECES:
        older.clear()
        older.update(known)
        known.clear()
    return out


def _coder(path: str, pattern: str, end: int, wide: bool):
    def code(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = encode_batch(part.column("text").to_pylist(), path, pattern, end, wide)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), part.column("bucket"), pa.array(ids, pa.binary())], ["id", "tie", "bucket", "ids"])

    return code


def _store(folder: str, name: str, data: bytes) -> None:
    """Under a name of its own first, so that a task that is run again leaves a whole file."""
    import uuid

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, f"{root}/{name}")


_MANIFEST = "file string, bucket int, number int, n_docs long, n_ids long"


def _writer(folder: str, wide: bool):
    def files(batches):
        """Rows come sorted by (bucket, id, tie): a file for each bucket, or several where one would be large
        or its doc_ids too far apart (rows without an id are never with others)."""
        size = 4 if wide else 2
        ids, held, where, number, n = [], [], None, 0, 0

        def close():
            name = f"part-{where:08d}-{number:06d}.eftk"
            _store(folder, name, file_bytes(held, ids, wide))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (where, pa.int32()), (number, pa.int32()), (len(ids), pa.int64()), (n, pa.int64()))], ["file", "bucket", "number", "n_docs", "n_ids"])

        for batch in batches:
            for id_, bucket, packed in zip(*(batch.column(x).to_pylist() for x in ("id", "bucket", "ids"))):
                if ids and (bucket != where or n >= FILE_IDS or id_ - ids[0] >= 1 << 62 or (ids[0] == NO_ID) != (id_ == NO_ID)):
                    yield close()
                    number = number + 1 if bucket == where else 0
                    ids, held, n = [], [], 0
                where = bucket
                ids.append(id_)
                held.append(packed)
                n += len(packed) // size
        if ids:
            yield close()

    return files


def write_files(docs: DataFrame, folder: str, path: str | None = None, pattern: str | None = None, end: int = 0, wide: bool = False) -> DataFrame:
    """Encode every text and write the ids, in ascending doc_id order over all files; the manifest, a table:
    file, bucket, number, n_docs, n_ids, start.

    Null text is empty and has the end id alone; a very long text is encoded and held whole, and its file
    has little else.  Rows without a doc_id stand before all others, and their doc_id is given as -2**63;
    rows that share a doc_id stand in the order of their texts' hash; rows that repeat are each written;
    columns but doc_id and text are left out.  The texts are encoded where they are read; only ids are
    shuffled, by ranges of about equal bytes.  An empty table gives no files.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)
    base, parts = ranged(docs, RANGE_BYTES)
    coded = base.mapInArrow(_coder(path, pattern, end, wide), "id long, tie long, bucket int, ids binary")
    placed = coded.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "id", "tie")
    made = written(placed.mapInArrow(_writer(folder, wide), _MANIFEST), "manifest")
    # ids before a file: two levels, so that no window has more rows than there are ranges or files of one
    first = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("bucket").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = made.groupBy("bucket").agg(F.sum("n_ids").alias("ids")).select("bucket", F.coalesce(F.sum("ids").over(first), F.lit(0)).alias("before"))
    return made.join(before, "bucket").withColumn("start", F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("before")


def _reader(folder: str):
    def rows(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    part = TokenFile(f.read())
                for names, starts, ends in part.runs():
                    crc = [zlib.crc32(part.body[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; as many tasks as ranges of
    ids.  The offsets are selected from the coded sequences."""
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), (manifest.agg(F.max("bucket")).first()[0] or 0) + 1)
    out = manifest.repartitionById(parts, F.col("bucket")).select("file", "start").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID).cast("long")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read_files(write_files(documents(spark, sf_dir), folder), folder)

"""Alignment of two tokenizers' tokens over the same bytes, and what it says about their vocabularies."""

from __future__ import annotations

from array import array
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Spelling, splitter
from .common import Scratch, attach, documents, let_go, small_batches, written
from .pieces import CHUNK, loaded
from .textops import chunks

PIECES = 200_000  # encoded pieces in each of two generations that a task remembers
PAIRS_HELD = 1_000_000  # id pairs that are counted in a task before they are sent on
#: Pairs of ids, in all, up to which their counts are broadcast (24 bytes each); more are joined.
MOST_BROADCAST = 1_000_000
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library, whose special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_file(path), splitter(pattern)
        self.tokenizer.encode_special_tokens = True
        letter = _byte_letters()
        tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(map(letter.__getitem__, token)) if all(c in letter for c in token) else token.encode()
        self.spelling, self.known, self.older = Spelling(tokens), {}, {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text that is not empty, and the n + 1 offsets.  Merges never cross the
        pieces of the splitter, so each distinct piece is encoded once and remembered."""
        pieces = [self.split(" " + t) if t else [] for t in texts]
        known, ask = self.known, []
        for p in set().union(*pieces).difference(known):
            if p in self.older:
                known[p] = self.older[p]
            else:
                ask.append(p)
        for at in range(0, len(ask), 20_000):
            part = ask[at : at + 20_000]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw, word = array("i", got.ids).tobytes(), np.array(got.word_ids)
            cuts = (np.searchsorted(word, np.arange(len(part) + 1)) * 4).tolist()
            for n, p in enumerate(part):
                known[p] = raw[cuts[n] : cuts[n + 1]]
        rows = [b"".join(map(known.__getitem__, row)) for row in pieces]
        if len(known) > PIECES:
            self.older, self.known = known, {}
        return np.frombuffer(b"".join(rows), "<i4"), np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)])


def _byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: visible Latin-1 characters are
    themselves, the other bytes follow from U+0100 on in their order."""
    out, shift = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + shift)] = b
            shift += 1
    return out


@cache
def _byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


def _spells(ids, at, spelling: Spelling, data, offs) -> np.ndarray:
    """Of each document whether the bytes of its ids are its bytes in ``data``."""
    size = np.concatenate([[0], np.cumsum(spelling.size[ids])])[at]
    same = np.diff(size) == np.diff(offs)
    if same.all() and size[-1] == len(data):
        wrong = np.frombuffer(spelling.joined(ids), np.uint8) != data
        return np.diff(np.concatenate([[0], np.cumsum(wrong)])[offs]) == 0
    for n in np.flatnonzero(same).tolist():
        same[n] = spelling.joined(ids[at[n] : at[n + 1]]) == data[offs[n] : offs[n + 1]].tobytes()
    return same


def _taken(ids, at, good) -> tuple[np.ndarray, np.ndarray]:
    """Only the ids of good documents."""
    count = np.where(good, np.diff(at), 0)
    return ids[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(count)])


#: Decimal digits of numbers below 100,000, right-aligned, 0 where there is none.
@cache
def _digits() -> np.ndarray:
    n = np.arange(100_000)
    cols = [np.where((n >= 10**k) | (k == 0), n // 10**k % 10 + 48, 0) for k in range(4, -1, -1)]
    return np.stack(cols, axis=1).astype(np.uint8)


def _spelled_groups(a, at_a, group_a, b, at_b, group_b, n_groups) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all documents in a row, and the n + 1 offsets of each one's (its last
    mark is one too many)."""
    before_a = np.searchsorted(group_a, np.arange(n_groups + 1))
    before_b = np.searchsorted(group_b, np.arange(n_groups + 1))
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
    cells = np.zeros((len(a) + len(b), 6), np.uint8)
    cells[place_a, :5], cells[place_b, :5] = _digits()[a], _digits()[b]
    cells[place_a, 5] = cells[place_b, 5] = ord(",")
    cells[place_a[before_a[1:] - 1], 5], cells[place_b[before_b[1:] - 1], 5] = ord("|"), ord(";")
    used = cells != 0
    size = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return cells[used].tobytes(), size[at_a + at_b]


def align(data: np.ndarray, offs: np.ndarray, a, at_a, b, at_b, size_a, size_b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A token and B token of each link) of documents in a row.

    ``offs``: their byte offsets.  The ends of A and of B tokens are counted by byte once for all
    documents; where both end is a cut.  The running sum of cuts is a token's group, and the two tokens
    that end at a cut are linked.
    """
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cut = (np.bincount(ends_a, minlength=len(data) + 1) > 0) & (np.bincount(ends_b, minlength=len(data) + 1) > 0)
    cuts = np.cumsum(cut)
    group_a, group_b = cuts[ends_a] - cut[ends_a], cuts[ends_b] - cut[ends_b]
    return group_a, group_b, np.flatnonzero(cut[ends_a]), np.flatnonzero(cut[ends_b])


def _aligned_chunk(texts: pa.Array, data, offs, byte, piece):
    """n_a, n_b, n_groups, digests, and of each document the distinct pairs and how often it has them."""
    # a space before every text that is not empty; other rows have no bytes
    full = np.diff(offs) > 0
    grown = offs + np.concatenate([[0], np.cumsum(full)])
    bytes_ = np.full(grown[-1], 32, np.uint8)
    inner = np.ones(len(bytes_), bool)
    inner[grown[:-1][full]] = False
    bytes_[inner] = data
    a, at_a = byte.encode(["" if t is None else t for t in texts.to_pylist()])
    b, at_b = piece.encode(data, offs)
    good = full & _spells(a, at_a, byte.spelling, bytes_, grown) & _spells(b, at_b, piece.spelling, bytes_, grown)
    if not good.all():
        a, at_a = _taken(a, at_a, good)
        b, at_b = _taken(b, at_b, good)
        bytes_ = bytes_[np.repeat(good, np.diff(grown))]
        grown = np.concatenate([[0], np.cumsum(np.where(good, np.diff(grown), 0))])
    group_a, group_b, link_a, link_b = align(bytes_, grown, a, at_a, b, at_b, byte.spelling.size, piece.spelling.size)
    n = len(good)
    doc_of = np.searchsorted(at_a, link_a, "right") - 1
    n_groups = np.bincount(doc_of, minlength=n)
    written_, size = _spelled_groups(a, at_a, group_a, b, at_b, group_b, len(link_a))
    digests = [sha256(written_[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(size[:-1].tolist(), size[1:].tolist())]
    pair = a[link_a].astype(np.int64) << 32 | b[link_b]
    order = np.lexsort((pair, doc_of))
    pair, doc_of = pair[order], doc_of[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc_of[1:] != doc_of[:-1])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(pair)))
    at = np.searchsorted(doc_of[first], np.arange(n + 1))
    return np.diff(at_a), np.diff(at_b), n_groups, digests, pair[first], often, at


def _rows(byte_path: str, pattern: str, piece_path: str):
    def rows(batches):
        byte, piece = _byte_tokenizer(byte_path, pattern), loaded(piece_path)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i, j, data, offs in chunks(texts, CHUNK):
                n_a, n_b, n_groups, digests, pair, often, at = _aligned_chunk(texts.slice(i, j - i), data, offs, byte, piece)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (pair, often.astype(np.int32))]
                cols = [pa.array(np.arange(number, number + j - i)), ids.slice(i, j - i), *map(pa.array, (n_a, n_b, n_groups, n_groups)), pa.array(digests), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "often"])
                number += j - i
        byte.known, byte.older = {}, {}
        let_go()

    return rows


def _summed(batches):
    """Pairs and their counts, summed within a task as far as they fit."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["pair", "n"])
    for batch in batches:
        pair, at = np.unique(np.concatenate([held[0], batch.column(0).flatten().to_numpy()]), return_inverse=True)
        n = np.concatenate([held[1], batch.column(1).flatten().to_numpy()])
        held = (pair, np.bincount(at, n, minlength=len(pair)).astype(np.int64))
        if len(pair) > PAIRS_HELD:
            yield out(held)
            held = (held[0][:0], held[1][:0])
    yield out(held)


def _looked_up(sent):
    """n_best and count_sum of rows by a broadcast table of all pairs."""

    def look(pairs: pa.Array, often: pa.Array) -> pa.Array:
        known, count, best = sent.value
        at = np.searchsorted(known, pairs.flatten().to_numpy())
        n, edges = often.flatten().to_numpy().astype(np.int64), pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (n * best[at], n * count[at])]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sums], ["n_best", "count_sum"])

    return F.arrow_udf(look, "n_best long, count_sum long")


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, pattern: str | None = None, most_broadcast: int = MOST_BROADCAST, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text, whose tokens by
    a byte-level BPE (A) and a piece model (B) are cut into groups where both end.

    Null and empty texts, and those that one of the tokenizers does not spell byte by byte (with U+2581,
    which a piece model takes for a space), have zeros and an empty groups_sha256; special tokens' strings
    are plain text; a very long text is handled whole, in memory of about 150 times its bytes; rows that
    repeat are each counted and null ids stay; columns but doc_id and text are left out; an empty table
    gives no rows.

    One table is written, a row for each document with its distinct pairs.  Pair counts are summed in
    tasks before they are shuffled.  Their number is bounded by the vocabularies, not by the input; up
    to ``most_broadcast`` of them are broadcast, beyond that the documents' pairs are joined to them,
    frequent ones dealt by chance.
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    paths = byte_path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN, piece_path or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, pairs array<long>, often array<int>"
    base = written(docs.select("doc_id", "text").mapInArrow(_rows(*paths), out), "aligned", scratch)
    counts = base.select("pairs", "often").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = written(counts, "paircounts", scratch)
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))
    judged = counts.withColumn("b", b_id).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
    plain = ["doc_id", *_COUNTS]
    n_pairs = counts.count()
    if n_pairs <= most_broadcast:
        table = judged.toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))
        return base.withColumn("found", _looked_up(sent)("pairs", "often")).select(*plain, "found.n_best", "found.count_sum", "groups_sha256")
    rows = base.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.often").alias("n"))
    met = attach(rows, judged, "pair", "count", rows.count())
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.select("row", *plain, "groups_sha256").join(sums, "row", "left").select(*plain, zero("n_best"), zero("count_sum"), "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))

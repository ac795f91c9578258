"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_rest, documents, giving_back, small_batches, unused
from .textops import chunks, mixed

ORDERS = (1, 2, 3, 4)  # characters of an n-gram
BUCKETS = 1 << 16
MOST_LANGS = 256  # the matrix is at most 256 * 65,536 numbers of 4 bytes; more languages are an error
WINDOW = 1 << 17  # characters whose n-grams are counted at once
CELLS = 1 << 21  # log probabilities gathered at once
HELD = 2_000_000  # counts that a task holds before it sums them up
_STEP, _ORDER = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F
_LETTER = regex.compile(r"\p{L}")


@cache
def _lower() -> np.ndarray:
    """The lower case of each of the first 65,536 characters, where that is one character."""
    return np.array([ord(x) if len(x := chr(n).lower()) == 1 and not 0xD800 <= n < 0xE000 else n for n in range(1 << 16)], np.uint32)


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 bytes, and the rows' offsets in them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    if len(points) == len(data):
        return _lower()[points], offs
    small = points < 1 << 16
    points = np.where(small, _lower()[np.where(small, points, 0)], points)
    return points, np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offs]


def grams(points: np.ndarray, left: np.ndarray, orders, buckets: int):
    """For each order, the buckets of the n-grams that start at each character, and whether each lies
    within one text, of which ``left`` characters are left."""
    n, h = len(points), np.zeros(len(points), np.uint64)
    for k in range(1, max(orders) + 1):
        h = h * _STEP
        h[: n - k + 1] += points[k - 1 :] + np.uint64(1)
        if k in orders:
            yield (mixed(h + np.uint64(k * _ORDER & (1 << 64) - 1)) & np.uint64(buckets - 1)).astype(np.uint32), left >= k


def sparse(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each is there."""
    keys = np.sort(np.concatenate(keys))
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)[: len(keys)])
    return keys[ends], np.diff(ends, prepend=-1)


def counted(col: pa.Array, orders, buckets: int, rows=None):
    """Sparse counts of a text column: (row, bucket, n) sorted by row and bucket, run by run; a long text
    takes several runs.  ``rows`` gives each row's number, by default its place."""
    overlap = max(orders) - 1
    for i, j, data, offs in chunks(col, WINDOW):
        points, at = characters(data, offs)
        end = np.repeat(at[1:], np.diff(at))
        own = np.repeat(np.arange(i, j) if rows is None else rows[i:j], np.diff(at)).astype(np.uint64) * np.uint64(buckets)
        for w in range(0, len(points), WINDOW):
            part = slice(w, w + WINDOW + overlap)
            keys, here = [], np.arange(len(points[part])) < WINDOW
            base = own[part]
            small = base[-1] < 1 << 32 and base[0] < 1 << 32 and int(base.max()) + buckets <= 1 << 32
            for gram, inside in grams(points[part], end[part] - np.arange(w, w + len(base)), orders, buckets):
                ok = inside & here
                keys.append((base[ok].astype(np.uint32) if small else base[ok]) + (gram[ok] if small else gram[ok].astype(np.uint64)))
            key, n = sparse(keys)
            yield (key // key.dtype.type(buckets)).astype(np.int64), (key % key.dtype.type(buckets)).astype(np.int64), n


def _counter(langs: list, orders, buckets: int):
    place = {x: n for n, x in enumerate(langs)}

    def count(batches):
        """Counts of a task, as rows of (language, bucket, n)."""
        held, size = [], 0

        def summed():
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            rows = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for lang, gram, n in counted(batch.column(0), orders, buckets, rows):
                key = lang * buckets + gram  # rows of a run may share a language, so a key may come again
                held.append((key, n))
                size += len(key)
                if size > HELD:
                    held, size = [summed()], 0
        if held:
            key, n = summed()
            for at in range(0, len(key), 50_000):
                own = key[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(own // buckets, pa.int32()), pa.array(own % buckets, pa.int32()), pa.array(n[at : at + 50_000])], ["lang", "gram", "n"])

    return count


def _dense(buckets: int):
    def row(table: pa.Table) -> pa.Table:
        held = np.zeros(buckets, np.int64)
        held[table.column("gram").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang")[:1], "counts": [held.tobytes()]})

    return row


class NaiveBayes:
    """log P(language) and log P(bucket | language), learned from all labelled rows given.

    The counts of a task are bounded by languages times buckets and are summed by Spark; the driver gets
    a row for each language, and that is broadcast.
    """

    def __init__(self, rows: DataFrame, orders=ORDERS, buckets: int = BUCKETS, alpha: float = 0.5):
        """``rows``: text, lang (not null)."""
        spark = rows.sparkSession
        found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGS + 1).collect()
        if len(found) > MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} languages")
        self.langs, self.orders, self.buckets = [r["lang"] for r in found], orders, buckets
        logs = np.full((buckets, max(1, len(found))), -np.log(buckets), np.float32)
        if found:
            each = rows.select(F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(giving_back(_counter(self.langs, orders, buckets)), "lang int, gram int, n long")
            table = each.groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(_dense(buckets), "lang int, counts binary")
            for r in table.toLocalIterator():
                n = np.frombuffer(r["counts"], np.int64)
                logs[:, r["lang"]] = np.log(n + alpha) - np.log(n.sum() + alpha * buckets)
        prior = np.log([r["n"] for r in found]) - np.log(sum(r["n"] for r in found)) if found else np.zeros(1)
        self.sent = spark.sparkContext.broadcast((prior, logs))

    def scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, the number of the likeliest language, its posterior probability, and the mean
        log probability of an n-gram in it.  The sparse counts of a run of texts are multiplied with the
        log probabilities of their buckets and summed by row."""
        prior, logs = self.sent.value
        total, size = np.zeros((len(col), len(prior))), np.zeros(len(col))
        step = max(1, CELLS // len(prior))
        for row, gram, n in counted(col, self.orders, self.buckets):
            for at in range(0, len(row), step):
                r, g, c = row[at : at + step], gram[at : at + step], n[at : at + step]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                total[r[first]] += np.add.reduceat(logs[g] * c[:, None].astype(np.float32), first, axis=0, dtype=float)
                size[r[first]] += np.add.reduceat(c, first)
        fit = total.max(axis=1) / np.maximum(size, 1)
        total += prior
        best = total.argmax(axis=1)
        return best, 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), fit


def _tagger(model: NaiveBayes, names: tuple[str, ...]):
    langs = pa.array([*model.langs, "und"])

    def tag(batches):
        for batch in batches:
            text = batch.column("text")
            best, score, fit = model.scores(text)
            none = np.array([x is None or not _LETTER.search(x) for x in text.to_pylist()], bool) | (not model.langs)
            best, score = np.where(none, len(model.langs), best), np.where(none, 0.0, score)
            yield pa.RecordBatch.from_arrays([*batch.columns, langs.take(pa.array(best)), pa.array(score), *[pa.array(fit)] * (len(names) - 2)], [*batch.schema.names, *names])

    return tag


def learn(docs: DataFrame, held_out: bool = True) -> NaiveBayes:
    """The model of the rows with a language; with ``held_out``, of those whose crc32 of doc_id is not 2 modulo 4."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null")
    return NaiveBayes((rows.where(crc_rest(F.col("doc_id"), 4) != 2) if held_out else rows).select("text", "lang"))


def identified(docs: DataFrame, model: NaiveBayes, names: tuple[str, ...] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` and two columns more, by default lang_pred and lang_score of each text, and with a third
    name the mean log probability of an n-gram.  ``und`` with score 0 where the text is null or has no
    letter (or nothing could be learned); ties go to the language first by code point.  A very long text
    is read whole, in windows; rows that repeat are each tagged; other columns, null or not, stay; an
    empty table gives no rows."""
    small_batches(docs.sparkSession)
    if set(names) & set(docs.columns):
        raise ValueError(f"the table has a column {' or '.join(names)} already")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(giving_back(_tagger(model, names)), f"{kinds}, `{names[0]}` string, `{names[1]}` double" + f", `{names[-1]}` double" * (len(names) - 2))


def in_language(docs: DataFrame, least: float = 0.5, margin: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in some learned language, columns as they are.

    That is: it has a letter, its language has this probability at least among the learned ones, and
    its n-grams are not less likely in that language, by a factor of e to the ``margin`` on average, than
    if all buckets were equally likely, as they are in text of none.  Null and empty texts go, also those without a lang stay by their text; without any
    labelled row all go; an empty table gives no rows.
    """
    names = tuple(unused(docs, n) for n in ("lang_pred", "lang_score", "lang_fit"))
    model = learn(docs, held_out=False)
    pred, score, fit = (F.col(f"`{n}`") for n in names)
    out = identified(docs, model, names).where((pred != "und") & (score >= least) & (fit > -float(np.log(model.buckets)) - margin))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identified(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", (crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

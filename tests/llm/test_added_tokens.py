"""Strings of added tokens in a text."""

import zlib

import numpy as np
import pytest

from peakfold.llm import token_files

P = pytest.importorskip("public_tokenizers")


def test_token_files_know_added_tokens(spark, tmp_path):
    """As the library encodes by default; a later document's start follows."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain", "<|endoftext|><|endoftext|>", "<|endoftext |>", None, " x<|endoftext|>"]
    folder = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_files.read_files(token_files.write_files(docs, folder), folder).orderBy("doc_id").collect()
    tokenizer, want, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for n, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((n, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want and want[0][2] == 5


def test_offsets_are_selected(monkeypatch):
    """A file's runs come from select, block by block; a file holds no table of offsets."""
    ids = [np.arange(n % 7, dtype="<u2").tobytes() for n in range(3000)]
    data = token_files.file_bytes(ids, [n * n for n in range(3000)])
    part, asked, select = token_files.TokenFile(data), [], token_files.EliasFano.select
    monkeypatch.setattr(token_files.EliasFano, "select", lambda self, i, j=None: asked.append((i, j)) or select(self, i, j))
    rows = [x for names, starts, ends in part.runs(700) for x in zip(names.tolist(), starts.tolist(), ends.tolist())]
    assert (700, 1400) in asked and (2799, None) in asked
    assert [n for n, _, _ in rows] == [n * n for n in range(3000)] and [b - a for _, a, b in rows] == [n % 7 for n in range(3000)]
    assert [(a, b) for _, a, b in rows] == [part.bounds(i) for i in range(3000)] and part.ids(13).tolist() == list(range(6))
    assert len(data) - sum(map(len, ids)) < 3000 * 4


def test_many_files(spark, tmp_path, monkeypatch):
    """Files are cut by ids within a range; rows without an id have files of their own; all tasks read."""
    monkeypatch.setattr(token_files, "FILE_IDS", 40)
    rows = [(None, f"none {n}") for n in range(50)] + [(n, f"text {n}") for n in (-(1 << 63) + 1, -5, *range(50), (1 << 63) - 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_files(docs, folder)
    got = token_files.read_files(manifest, folder)
    assert got.rdd.getNumPartitions() >= manifest.select("bucket").distinct().count() > 1 and manifest.count() > 8
    got, at = sorted(got.collect(), key=lambda r: r.start), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 50 + sorted(i for i, _ in rows if i is not None)

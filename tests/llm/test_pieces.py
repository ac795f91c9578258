"""Op 11 against the sentencepiece library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from peakfold.llm import pieces

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(texts, library):
    model = pieces.loaded(PATH)
    for text, got, want in zip(texts, pieces.encode_texts(texts, PATH), library.encode(texts)):
        assert got.tolist() == want, text[:80]
        ids = [library.bos_id(), *want, library.eos_id()]
        assert model.decode(np.array(ids)) == library.decode(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=20))
def test_any_texts(texts):
    same(texts, sentencepiece.SentencePieceProcessor(model_file=PATH))


def test_mixtures(library):
    r = random.Random(3)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    draws = [
        lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), lambda n: "".join(r.choice("ab  ") for _ in range(n)),
        lambda n: "".join(r.choice(names) for _ in range(n)), lambda n: "".join(r.choice(["th", "in", "er", "an", "he", "e"]) for _ in range(n)),
        lambda n: " " * n + r.choice(["", "a", "\n", "the", "▁"]) + " " * r.randint(0, 40) + "x", lambda n: "".join(r.choice(["aa", "=", " ", "-", "\t"]) for _ in range(n)),
    ]
    for draw in draws:
        same([draw(n) for n in (0, 1, 2, 15, 16, 17, 31, 32, 33, 40, 200, 1_000)], library)


@pytest.mark.parametrize("text", ["qwertyuiopasdfgh" * 9_000, " " * 200_000, "a" * 100_001, "the" * 20_000, "th" * 3_000, "0" * 50_000 + "é" * 50_000])
def test_very_long_words(library, text):
    same([text], library)


def test_rounds_and_heap_agree(library):
    model, r = pieces.loaded(PATH), random.Random(4)
    for _ in range(200):
        text = "".join(r.choice("theanrio") for _ in range(r.randint(2, 120)))
        sym = model.symbol_of[model.class_of[[ord(c) for c in text]]]
        left, _ = model.merged(sym, np.zeros(1, np.int64))
        assert left.tolist() == model._from_heap(sym.tolist())


def test_any_ids_decode(library):
    model, r = pieces.loaded(PATH), random.Random(5)
    for _ in range(500):
        ids = [r.choice([r.randint(0, 258), r.randint(0, 31_999)]) for _ in range(r.randint(0, 8))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)


def test_whole_query(spark, docs, rows, library):
    got = sorted((tuple(r) for r in pieces.encoded(docs).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha256(np.array(ids, "<u4")).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_and_clashing(spark, empty):
    assert pieces.encoded(empty).count() == 0
    df = spark.createDataFrame([("x", None, 5), (None, "some text", 6)], "doc_id string, text string, n_tokens int")
    out = pieces.encoded(df, with_ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {r["doc_id"]: r["ids"][:1] for r in out.collect()} == {"x": [1], None: [1]}

"""Op 12 against a plain version over the libraries' own tokens."""

from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from peakfold.llm import alignment

COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "doc_id long, text string, n_a int, row string, pairs string, found int"
HARD = [
    "", None, " ", "  two  spaces  ", "a▁mark", "plain <|endoftext|> and <s> text", "Łódź, naïve – “quoted”", "日本語のテキスト 😀😀", "tab\tline\n\n\nmore", "x" * 400, "\x00\x01",
    "the the the", "the the the", "é composed", " lead", "trail ",
]


def letters():
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(texts):
    byte = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letter, done, links, counts = letters(), [], [], Counter()
    for text in texts:
        row, own = [0, 0, 0], []
        want, digest = (" " + (text or "")).encode(), ""
        if text:
            a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
            a_bytes = [bytes(letter[c] for c in byte.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == want == b"".join(b_bytes):
                x = y = i = j = 0
                groups, left, right = [], [], []
                while i < len(a) or j < len(b):
                    if x <= y:
                        x += len(a_bytes[i])
                        left.append(a[i])
                        i += 1
                    else:
                        y += len(b_bytes[j])
                        right.append(b[j])
                        j += 1
                    if x == y:
                        own.append((left[-1], right[-1]))
                        groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                        left, right = [], []
                row, digest = [len(a), len(b), len(groups)], sha256(";".join(groups).encode()).hexdigest()
        counts.update(own)
        links.append(own)
        done.append((row, digest))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(*row, len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), digest) for (row, digest), own in zip(done, links)]


@pytest.mark.parametrize("most", [alignment.MOST_BROADCAST, 0])
def test_equal_to_the_plain_version(spark, docs, rows, most):
    texts = [(r[0], r[1]) for r in rows] + [(1000 + n, t) for n, t in enumerate(HARD)] + [(1500, HARD[6])] * 2
    df = spark.createDataFrame([(i, t, 1, "r", "p", 2) for i, t in texts], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in alignment.aligned(df, most_broadcast=most).select(COLS).collect()), key=str)
    want = sorted(((i, *r) for (i, _), r in zip(texts, plain([t for _, t in texts]))), key=str)
    assert got == want


def test_empty_table(spark, empty):
    for most in (0, 10):
        found = alignment.aligned(empty, most_broadcast=most)
        assert found.columns == COLS and found.count() == 0


def test_a_text_beyond_a_chunk(spark):
    text = "A sentence that goes on, with naïve words; " * 30_000
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r[0]: tuple(r)[1:] for r in alignment.aligned(df).select(COLS).collect()}
    assert [got[i] for i in (1, 2, 3)] == plain([text, "short one", None])

"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession


from .common import documents, let_go, small_batches

MOVES = 300_000  # transitions held at once; all are made anew when there are more
LOOKAHEAD = 32  # bytes not settled from which the machine looks for tokens to emit
FOLLOWS, SPINES = 100_000, 10_000  # pairs of tokens, and tokens, whose borders are remembered
LONG = 200  # characters beyond which a piece is not remembered
PIECES = 90_000  # encoded pieces in each of two generations that a task remembers
OUT_BYTES, OUT_ROWS = 1 << 20, 500  # ids and rows of a batch that goes out, about
NEVER = 1 << 40


@cache
def splitter(pattern: str):
    """findall for the pieces of a text.  White space is Unicode's property of that name.  Texts of
    Latin letters take an equal pattern of the faster module if the pattern is the usual one."""
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    whole = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
    if pattern != usual:
        return whole
    # all of U+00C0 to U+024F but the two signs are letters
    letters, space = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"\t-\r "
    plain = usual.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}0-9]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", "[0-9]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    plain, other = re.compile(plain).findall, re.compile("[^\\x00-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]").search
    return lambda text: plain(text) if text.isascii() or not other(text) else whole(text)


class Transducer:
    """Reads bytes, emits token ids.

    The nondeterministic machine guesses where tokens end: a configuration is a place in the trie of
    the token being read and the token before it.  A guessed token may follow another only if no merge
    would cross their border (:meth:`may_follow`); then of each prefix just one guess ends there, the
    last token of that prefix's own merges.  A state of the deterministic machine is the set of
    configurations alive; its transitions, with the token that ends there, are made when first taken.
    All configurations alive began within the longest token's bytes, so that and ``LOOKAHEAD`` bound
    the bytes after which a token is out, however long the piece: what all of them agree on is emitted.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        self.parts = array("i", [-1]) * size, array("i", [-1]) * size  # of a merged token, left and right
        merge: dict[int, int] = {}
        usable = {n for t, n in ranks.items() if len(t) == 1}
        for token, n in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes[n] = token
            if len(token) > 1 and len(two := self._merged(token, n, merge)) == 2:
                self.parts[0][n], self.parts[1][n] = two
                merge[two[0] << 20 | two[1]] = n
                usable.add(n)
        self.merge, self.size = merge, array("i", map(len, self.bytes))
        # trie: nodes by depth and then by prefix, so that the children of a node are a run of ``labels``
        # and the child at place i of it is node i + 1
        prefixes = sorted({t[:i] for t in ranks for i in range(1, len(t) + 1)}, key=lambda p: (len(p), p))
        place = {p: n for n, p in enumerate([b"", *prefixes])}
        self.labels, self.depth = bytes(p[-1] for p in prefixes), array("i", [0, *map(len, prefixes)])
        children = np.bincount([place[p[:-1]] for p in prefixes], minlength=len(place)) if prefixes else np.zeros(1, int)
        self.first = array("i", np.concatenate([[0], np.cumsum(children)]).astype(np.int32).tobytes())
        self.ends = array("i", [-1]) * len(place)
        for n in usable:
            self.ends[place[self.bytes[n]]] = n
        self.follow: dict[int, bool] = {}
        self.spines: dict[int, list] = {}
        self._reset()

    def _merged(self, token: bytes, below: int, merge: dict[int, int]) -> tuple[int, ...]:
        """The token's parts by the merges of a lower rank."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((merge.get(a << 20 | b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [best]
        return tuple(parts)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the border byte up: (token, rank of the merge that takes it up)."""
        key = token << 1 | side
        out = self.spines.get(key)
        if out is None:
            out, up, parts = [], NEVER, self.parts[side]
            while token >= 0:
                out.append((token, up))
                token, up = parts[token], token
            out.reverse()
            if len(self.spines) > SPINES:
                self.spines.clear()
            self.spines[key] = out
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of a's bytes then b's bytes end as a, b: climb both borders in the order
        of the merges and look for one that would cross before."""
        key = a << 20 | b
        known = self.follow.get(key)
        if known is None:
            one, two, i, j, known = self._spine(a, 1), self._spine(b, 0), 0, 0, True
            while True:
                (x, up_x), (y, up_y) = one[i], two[j]
                across = self.merge.get(x << 20 | y, NEVER)
                if across < up_x and across <= up_y and across != NEVER:
                    known = False
                    break
                if up_x == up_y == NEVER:
                    break
                if up_x <= up_y:
                    i += 1
                else:
                    j += 1
            if len(self.follow) > FOLLOWS:
                self.follow.clear()
            self.follow[key] = known
        return known

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, int] = {}
        self._number((0,))

    def _number(self, state: tuple) -> int:
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def _move(self, state: int, byte: int) -> int:
        """The next state, from bit 28 up, and the token that ends here, below bit 20, in one number.  A
        configuration is the node and, in the low bits, the token before it plus one."""
        known, first, find, ends, follow = self.states[state], self.first, self.labels.find, self.ends, self.follow
        if len(self.moves) >= MOVES:
            self._reset()
            state = self._number(known)
        out, ended = [], -1
        for alive in known:
            node = alive >> 20
            node = find(byte, first[node], first[node + 1]) + 1
            if not node:
                continue
            before = alive & 0xFFFFF
            if first[node] < first[node + 1]:
                out.append(node << 20 | before)
            if ended < 0 and (token := ends[node]) >= 0:
                if before:
                    fits = follow.get(before - 1 << 20 | token)
                    if fits or fits is None and self.may_follow(before - 1, token):
                        ended = token
                else:
                    ended = token
        if ended < 0:
            raise ValueError(f"no token ends with byte {byte}")
        found = self.moves[state << 8 | byte] = self._number((ended + 1, *out)) << 28 | ended
        return found

    def _settled(self, state: int, ends: list[int]) -> list[int]:
        """The tokens that no configuration alive can change, which leave ``ends``, the token that ends at
        each byte since the last one that left."""
        paths, n = [], len(ends)
        for alive in self.states[state]:
            at, path = n - self.depth[alive >> 20], []
            while at > 0:
                path.append(at)
                at -= self.size[ends[at - 1]]
            paths.append(path[::-1])
        out, done = [], 0
        for borders in zip(*paths):
            if len(set(borders)) > 1:
                break
            done = borders[0]
            out.append(ends[done - 1])
        del ends[:done]
        return out

    def _walked(self, ends: list[int]) -> list[int]:
        at, out, size = len(ends), [], self.size
        while at:
            out.append(ends[at - 1])
            at -= size[out[-1]]
        out.reverse()
        return out

    def stream(self, piece):
        """Ids of an iterable of bytes, each as soon as no configuration alive can change it (looked for
        each time that ``LOOKAHEAD`` more bytes are read)."""
        moves, state, ends, wait = self.moves, 0, [], LOOKAHEAD
        for byte in piece:
            found = moves.get(state | byte)
            if found is None:
                found = self._move(state >> 8, byte)
                moves = self.moves
            state = found >> 20  # shifted for the next byte
            ends.append(found & 0xFFFFF)
            if len(ends) >= wait:
                yield from self._settled(state >> 8, ends)
                wait = len(ends) + LOOKAHEAD
        yield from self._walked(ends)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token, any other one is streamed."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) >= LOOKAHEAD:
            return list(self.stream(piece))
        known, state, ends = self.moves.get, 0, []  # nothing is settled before the end
        for byte in piece:
            found = known(state | byte)
            if found is None:
                found = self._move(state >> 8, byte)
                known = self.moves.get
            state = found >> 20
            ends.append(found)
        at, out, size = len(ends), [], self.size
        while at:
            token = ends[at - 1] & 0xFFFFF
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


class StreamDecoder:
    """Ids in, text out, a part at a time: a character whose bytes are not all there waits for the rest."""

    def __init__(self, tokens: "Spelling", errors: str = "strict"):
        self.tokens, self.machine = tokens, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids, last: bool = False) -> str:
        return self.machine.decode(self.tokens.joined(np.asarray(ids, np.int64)), last)


class Spelling:
    """The bytes of all tokens, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        place = np.cumsum(size)
        if not len(ids):
            return b""
        return self.data[np.repeat(self.start[ids] - place + size, size) + np.arange(place[-1])].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """The ids of pieces seen, as bytes.  When there are too many, those not met again for a while go."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.spelling, self.older = machine, Spelling(machine.bytes), {}

    def forget(self) -> None:
        self.clear()
        self.older = {}
        self.machine.follow.clear()
        self.machine.spines.clear()
        self.machine._reset()
        let_go()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > PIECES:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            found = array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= LONG:
            self[piece] = found
        return found


@cache
def _loaded(path: str) -> _Pieces:
    return _Pieces(Transducer(read_ranks(path)))


def encode_text(text: str, pieces: _Pieces, findall) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return b"".join(map(pieces.__getitem__, findall(text)))


def _coder(path: str, pattern: str, with_ids: bool):
    def code(batches):
        try:
            yield from coded(batches)
        finally:
            _loaded(path).forget()  # a worker that waits for its next task holds no caches

    def coded(batches):
        pieces, findall = _loaded(path), splitter(pattern)
        for batch in batches:
            names, rows, size = batch.column("doc_id"), [], 0
            for at, text in enumerate(batch.column("text")):
                packed = encode_text(text.as_py(), pieces, findall) if text.is_valid else b""
                numbers = np.frombuffer(packed, "<u4")
                stream, digest = StreamDecoder(pieces.spelling), sha256()
                for start in range(0, len(numbers), 1 << 14):
                    digest.update(stream.feed(numbers[start : start + (1 << 14)]).encode())
                digest.update(stream.feed((), True).encode())
                rows.append((len(numbers), sha256(packed).hexdigest(), digest.hexdigest(), packed if with_ids else b""))
                size += len(packed)
                if size >= OUT_BYTES or len(rows) >= OUT_ROWS or at == batch.num_rows - 1:
                    yield made(names.slice(at + 1 - len(rows), len(rows)), rows)
                    rows, size = [], 0

    def made(names, rows):
        n, sums, decoded, ids = zip(*rows)
        cols = [names, pa.array(n, pa.int64()), pa.array(sums), pa.array(decoded)]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return code


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text.  ``path``: a rank file that
    all workers can read.

    Null counts as empty, and an empty text has no ids; a very long text, or a very long piece of one,
    is read whole, in memory of about 30 times its bytes; rows that repeat are each encoded, null ids
    stay; columns but doc_id and text are left out; an empty table gives no rows."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_coder(path, pattern, with_ids), out)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))

"""SentencePiece BPE by vectorised merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

from functools import cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Spelling
from .common import documents, let_go, small_batches
from .textops import buffers, chunks, span_hashes

SPACE = 0x2581  # the mark that stands for a space
#: Kinds of pieces in a model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Symbols of a word from which its merges are found by windows and not by the word.
LONG = 32
MOST_ROUNDS = 400  # of a word that is longer
NONE = 1 << 30  # the rank of a pair that no merge takes
CHUNK = 1 << 20  # bytes of text handled at once; a longer document is handled alone, whole


class PieceModel:
    """A byte-fallback BPE model without normalisation rules, as arrays.

    Symbols are the piece ids, and ids beyond them for characters that are only part of pieces.  The
    merge of two symbols has the rank of the piece they make, equal scores equal ranks, so the order of
    merges is (rank, place).
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as fields

        with open(path, "rb") as f:
            model = fields.ModelProto.FromString(f.read())
        rules, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("not a BPE model without normalisation and with a space before the text")
        if USER in kinds or UNUSED in kinds or kinds.count(BYTE) != 256:
            raise ValueError("user-defined or unused pieces, or no byte pieces")
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        names = [p.piece for p in model.pieces]
        ids = {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}
        for c in sorted({c for p in ids for c in p}):
            ids.setdefault(c, len(ids) + len(names))
        self.n_pieces, self.n_symbols = len(names), max(max(ids.values()) + 1, len(names))
        self.byte_of = np.full(self.n_symbols, -1, np.int16)
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(names):
            if kinds[i] == BYTE:
                self.byte_of[i] = int(p[3:5], 16)
                self.byte_ids[int(p[3:5], 16)] = i
        # symbols of code points; the last class is that of all others, which no merge takes
        self.class_of = np.full(0x110000, -1, np.int32)
        chars = [c for c in ids if len(c) == 1]
        self.symbol_of = np.array([ids[c] for c in chars] + [-1], np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(len(chars))
        self.class_of[self.class_of < 0] = len(chars)
        self.n_classes = len(chars) + 1
        self.joins = np.zeros((self.n_classes, self.n_classes), bool)  # two characters that stand together in a piece
        scores = sorted({model.pieces[i].score for i in ids.values() if i < len(names)}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        keys, made, ranks = [], [], []
        for p, i in ids.items():
            if i >= len(names):
                continue
            for k in range(1, len(p)):
                self.joins[self.class_of[ord(p[k - 1])], self.class_of[ord(p[k])]] = True
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n_symbols + b)
                    made.append(i)
                    ranks.append(place[model.pieces[i].score])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int32)[order], -1)
        self.ranks = np.append(np.array(ranks, np.int64)[order], NONE)
        # pieces whose own merges all come after them: until the last such pair is merged, merging one opens none
        rank_of = np.full(self.n_symbols, NONE, np.int64)
        np.minimum.at(rank_of, self.made[:-1], self.ranks[:-1])
        wild = np.zeros(self.n_symbols, bool)
        for part in (self.keys[:-1] // self.n_symbols, self.keys[:-1] % self.n_symbols):
            wild[part[self.ranks[:-1] <= rank_of[part]]] = True
        self.calm = np.append(~wild[self.made[:-1]], False)
        self.longest = max(map(len, ids))
        self.run = self._space_run(ids, {i: p.score for i, p in enumerate(model.pieces)})
        self._place_of = None
        spelled = []
        for i, p in enumerate(names):
            spelled.append(b"" if kinds[i] == CONTROL else bytes([self.byte_of[i]]) if kinds[i] == BYTE else model.trainer_spec.unk_surface.encode() if kinds[i] == UNKNOWN else p.replace(chr(SPACE), " ").encode())
        self.spelling = Spelling(spelled)
        self.widths = np.ones(self.n_symbols + 1, np.int64)  # characters of each symbol, and of none
        self.widths[: len(names)] = [len(p) for p in names]
        self.shown = np.array([k != CONTROL for k in kinds])

    def _space_run(self, ids: dict, score: dict) -> int:
        """The longest piece of spaces, if a run of spaces is surely cut into such from its left; else 0.

        That holds if pieces of spaces are merged after all others and from the left, as their scores are
        equal, if so many spaces alone become that piece, and if a space stands in no other piece but first.
        """
        mark = chr(SPACE)
        runs = {len(p): i for p, i in ids.items() if set(p) == {mark} and len(p) > 1 and i in score}
        low = {score[i] for i in runs.values()}
        others = [(p, score[i]) for p, i in ids.items() if i in score and len(p) > 1 and i not in runs.values()]
        if len(low) != 1 or any(s <= min(low) or mark in p[1:] for p, s in others) or mark not in ids:
            return 0
        left, _ = self.merged(np.full(max(runs), ids[mark], np.int32), np.zeros(1, np.int64))
        return max(runs) if left.tolist() == [runs[max(runs)]] else 0

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the table of merges, the last one for none."""
        key = a.astype(np.int64) * self.n_symbols + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when no pair of a word can merge, word after word, and their number a word.

        A round takes each word's least (rank, place), all words at once.  In words of more than
        ``LONG`` symbols it takes all pairs that are least among the pairs within two of the longest
        piece's length on either side: a merge of lower rank further off, and all it leads to before
        this one's turn, stays in the pieces that hold it, so it cannot reach this pair or what
        follows from it.  Of equal pairs the leftmost there, or every second one of a row of them, if
        merging them opens no pair that comes before them.  Merged symbols are compacted away, words
        without a pair left leave; a long word that repeats itself in the one way that still needs a
        round a merge is finished pair by pair from a heap.
        """
        n = len(starts)
        ends = np.append(starts[1:], len(symbols))
        long = ends - starts > LONG
        out_word, out_sym = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        word = np.repeat(np.arange(n), ends - starts)
        for far in (False, True):
            mine = long[word] == far
            self._rounds(symbols[mine], word[mine], 2 * self.longest if far else 0, out_word, out_sym)
        word, sym = np.concatenate(out_word), np.concatenate(out_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n)

    def _rounds(self, sym, word, window, out_word, out_sym) -> None:
        none, rounds = len(self.keys) - 1, 0
        at = np.full(len(sym), none, np.int32)  # the merge of each symbol with the next
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            at[same] = self.pairs(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            key = self.ranks[at] << 32 | np.arange(len(sym))
            least = np.minimum.reduceat(key, first)
            open_ = least < NONE << 32
            if not open_.all():
                stays = np.repeat(open_, np.diff(np.append(first, len(sym))))
                out_word.append(word[~stays])
                out_sym.append(sym[~stays])
                sym, word, at = sym[stays], word[stays], at[stays]
                continue
            rounds += 1
            if rounds > MOST_ROUNDS:
                for i, j in zip(first.tolist(), np.append(first[1:], len(sym)).tolist()):
                    left = self._from_heap(sym[i:j].tolist())
                    out_word.append(np.full(len(left), word[i]))
                    out_sym.append(np.array(left, np.int32))
                return
            i = self._certain(key, at, window) if window else least & 0xFFFFFFFF
            sym[i] = self.made[at[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            place = np.cumsum(keep) - 1
            i, sym, word, at = place[i], sym[keep], word[keep], at[keep]
            for j in (i[i > 0] - 1, i):
                at[j] = none
                j = j[j + 1 < len(sym)]
                j = j[word[j] == word[j + 1]]
                at[j] = self.pairs(sym[j], sym[j + 1])

    def _certain(self, key: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
        """The places of pairs that are least around them."""
        rank, place = self.ranks[at], np.arange(len(at))
        lowest = (rank == _around(rank, window)) & (rank < NONE)
        chosen = (key == _around(key, window)) & (rank < NONE)
        # rows of one and the same merge: its every second place from the left, as far as they are the lowest
        row_starts = np.ones(len(at), bool)
        row_starts[1:] = at[1:] != at[:-1]
        start = np.maximum.accumulate(np.where(row_starts, place, 0))
        others = np.cumsum(~lowest)
        chosen |= lowest & self.calm[at] & ((place - start) % 2 == 0) & (others == others[start]) & lowest[start]
        return np.flatnonzero(chosen)

    def _from_heap(self, sym: list[int]) -> list[int]:
        """The merges of one word, pair by pair, by (rank, place)."""
        n = len(sym)
        after, before, none = list(range(1, n + 1)), list(range(-1, n - 1)), len(self.keys) - 1
        if self._place_of is None:
            self._place_of = {k: q for q, k in enumerate(self.keys[:-1].tolist())}
        place_of, found = self._place_of, self.pairs(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        heap = [(int(self.ranks[p]), i, sym[i], sym[i + 1], p) for i, p in enumerate(found) if p != none]
        heapify(heap)
        while heap:
            _, i, a, b, p = heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = int(self.made[p]), None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    q = place_of.get(sym[left] * self.n_symbols + sym[right])
                    if q is not None:
                        heappush(heap, (int(self.ranks[q]), left, sym[left], sym[right], q))
        return [s for s in sym if s is not None]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at ``offs`` (n + 1 byte offsets) and the n + 1 offsets of each text's ids.

        Text is cut where no piece holds the two characters side by side, so no merge crosses a cut; a
        word that occurs often in these texts is merged once.
        """
        size = np.diff(offs)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars_before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        # a space before every text that is not empty
        full = size > 0
        begin = chars_before[:-1][full] + np.arange(full.sum())
        text = np.full(len(codes) + len(begin), SPACE, np.uint32)
        inner = np.ones(len(text), bool)
        inner[begin] = False
        text[inner] = np.where(codes == 32, SPACE, codes)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        kind = self.class_of[text]
        first = np.ones(len(text), bool)
        first[1:] = ~self.joins[kind[:-1], kind[1:]]
        first[begin] = True
        if self.run:
            blank = text == SPACE
            run_from = blank.copy()
            run_from[1:] &= ~blank[:-1] | first[1:]
            runs = np.flatnonzero(run_from)
            spot = np.flatnonzero(blank)
            first[spot[(spot - runs[np.searchsorted(runs, spot, "right") - 1]) % self.run == 0]] = True
        starts = np.flatnonzero(first)
        which, rep = self._distinct(text, starts)
        ends = np.append(starts[1:], len(text))
        ids, count = self._words(text, starts[rep], ends[rep])
        at = np.cumsum(count) - count
        took = count[which]
        out_end = np.cumsum(took)
        out = ids[np.repeat(at[which] - out_end + took, took) + np.arange(out_end[-1])]
        total = np.concatenate([[0], out_end])
        word_at = np.zeros(len(offs), np.int64)
        word_at[:-1][full] = np.searchsorted(starts, begin)
        word_at[-1] = len(starts)
        # an empty text begins where the next one does
        word_at = np.minimum.accumulate(np.where(np.append(full, True), word_at, len(starts))[::-1])[::-1]
        return out, total[word_at]

    @staticmethod
    def _distinct(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its distinct word, and for each distinct one a word that is it.
        Words of one hash are compared character by character."""
        ends = np.append(starts[1:], len(text))
        _, rep, which = np.unique(span_hashes(text, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        other = starts[rep][which]
        twin = np.repeat(other - starts, size) + np.arange(len(text))
        if (size != size[rep][which]).any() or (text[np.minimum(twin, len(text) - 1)] != text).any():
            return np.arange(len(starts)), np.arange(len(starts))
        return which, rep

    def _words(self, text, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the words, and their number."""
        size = ends - starts
        stop = np.cumsum(size)
        flat = text[np.repeat(starts - stop + size, size) + np.arange(stop[-1])]
        sym, count = self.merged(self.symbol_of[self.class_of[flat]], stop - size)
        lone = np.flatnonzero((sym < 0) | (sym >= self.n_pieces))  # characters that are no piece: their bytes
        if not len(lone):
            return sym, count
        word = np.repeat(np.arange(len(count)), count)
        spelled = {}
        # the characters of a symbol that is no piece are still one character; its place is found by what came before it
        width = self.widths[sym]
        place = np.cumsum(width) - width
        for i in lone.tolist():
            spelled[i] = self.byte_ids[list(chr(flat[place[i]]).encode())]
        took = np.ones(len(sym), np.int64)
        took[lone] = [len(spelled[i]) for i in lone.tolist()]
        out = np.repeat(sym, took)
        at = np.cumsum(took) - took
        for i in lone.tolist():
            out[at[i] : at[i] + took[i]] = spelled[i]
        return out, np.bincount(word, took, minlength=len(count)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids say nothing, the space before the first piece goes, bytes that
        are not UTF-8 become U+FFFD, one each."""
        shown = ids[self.shown[ids]]
        data = self.spelling.joined(shown)
        if len(shown) and self.byte_of[shown[0]] < 0 and data.startswith(b" ") and shown[0] != 0:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="surrogateescape").translate({0xDC00 + b: 0xFFFD for b in range(128, 256)})


def _around(key: np.ndarray, window: int) -> np.ndarray:
    """The least of the keys at most ``window`` places away."""
    least, reach = key.copy(), 0
    ahead, behind = key.copy(), key.copy()
    while reach < window:
        step = min(reach + 1, window - reach)
        if len(key) > step:
            ahead[:-step] = np.minimum(ahead[:-step], ahead[step:].copy())
            behind[step:] = np.minimum(behind[step:], behind[:-step].copy())
        reach += step
    return np.minimum(least, np.minimum(ahead, behind))


@cache
def loaded(path: str) -> PieceModel:
    return PieceModel(path)


def _coder(path: str, with_ids: bool):
    def code(batches):
        model = loaded(path)
        for batch in batches:
            names, column = batch.column("doc_id"), batch.column("text")
            for i, j, data, offs in chunks(column, CHUNK):
                ids, at = model.encode(data, offs)
                rows = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.empty(b - a + 2, "<i4")
                    own[0], own[-1] = model.bos, model.eos
                    own[1:-1] = ids[a:b]
                    rows.append((len(own), sha256(own).hexdigest(), sha256(model.decode(own).encode()).hexdigest(), own))
                n, sums, decoded, packed = zip(*rows)
                cols = [names.slice(i, j - i), pa.array(n, pa.int64()), pa.array(sums), pa.array(decoded)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(packed))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        let_go()

    return code


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text, with begin and end ids.
    ``path``: a model file that all workers can read.

    Null counts as empty, and an empty text has the begin and end ids alone; a very long text is read
    whole, in memory of about 100 times its bytes, and a very long word of it is merged in parallel;
    rows that repeat are each encoded, null ids stay; columns but doc_id and text are left out; an
    empty table gives no rows.  Nothing is shuffled.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_coder(path or public_tokenizers.path("piece_bpe_32k.model"), with_ids), out)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text, without begin and end."""
    data, offs = buffers(pa.array(texts, pa.large_string()))
    ids, at = loaded(path).encode(data[offs[0] : offs[-1]], offs - offs[0])
    return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))

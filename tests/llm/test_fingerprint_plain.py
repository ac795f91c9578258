"""Op 5's whole result against whole numbers in plain Python, one text, word and bin at a time."""

from hashlib import sha256

import pytest
import xxhash

from peakfold.llm import fingerprints

M = (1 << 64) - 1
# The constants of the hashes.
BASE = 0x9E3779B97F4A7C15
STEPS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def word(w):
    return mixed(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(w)) + len(w) & M)


def shingles(text, k):
    own = {}
    w = [own.get(x) or own.setdefault(x, word(x)) for x in (text or "").encode().lower().split()]
    if len(w) < k:
        return {mixed(sum(a * s for a, s in zip(w, STEPS)) + len(w) & M)} if w else set()
    return {mixed(sum((a if j < 2 else mixed(a)) * STEPS[j] for j, a in enumerate(w[i : i + k])) + k & M) for i in range(len(w) - k + 1)}


def fingerprint(text, k, bins, bits):
    least = {}
    for h in shingles(text, k):
        b = (h >> 32) * bins >> 32
        least[b] = min(h, least.get(b, M))
    if not least:
        return None
    out = []
    for b in range(bins):
        at, attempt = b, 1
        while at not in least:
            draw = mixed(b * 0x9E3779B1 + (attempt * 0x85EBCA77C2B2AE63 & M) & M)
            at, attempt = (draw >> 32) * bins >> 32, attempt + 1
        out.append(mixed(least[at] + b * BASE & M) & (1 << bits) - 1)
    return out


def hexed(own, bits):
    if own is None:
        return ""
    line = "".join(f"{x:0{bits}b}" for x in own)
    line += "0" * (-len(line) % 8)
    return bytes(int(line[i : i + 8], 2) for i in range(0, len(line), 8)).hex()


def alike(a, b, bits):
    if a is None or b is None:
        return float(a is b)
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(max((same - 2.0**-bits) / (1 - 2.0**-bits), 0.0), 1.0)


@pytest.mark.parametrize("k, bins, bits", [(5, 512, 4), (2, 64, 8)])
def test_whole_result(docs, rows, k, bins, bits):
    got = fingerprints.fingerprinted(docs, k, bins, bits).collect()

    def place(r):
        tie = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        return (-(1 << 63) if r[0] is None else r[0]), tie - (1 << 64) if tie >> 63 else tie

    line = sorted(rows, key=place)
    want = []
    for r, s in zip(line, line[1:] + line[:1]):
        t, u = r[1] or "", s[1] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + u[:n]
        one, two, three = (fingerprint(x, k, bins, bits) for x in (t, changed, u))
        want.append((r[0], len(t), sha256(changed.encode()).hexdigest(), hexed(one, bits), hexed(two, bits), round(alike(one, two, bits), 12), round(alike(one, three, bits), 12)))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in got), key=key) == sorted(want, key=key)

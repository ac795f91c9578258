"""The scan against plain Python over words."""

import random
import re
from collections import defaultdict
from functools import cache

import numpy as np

from peakfold.llm import license_scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@cache
def indexed():
    """Label, words, and the places of each run of words, of all templates."""
    out = []
    for label, template in license_scan.templates():
        t, places = words(template), defaultdict(list)
        for j in range(len(t) - license_scan.K + 1):
            places[tuple(t[j : j + license_scan.K])].append(j)
        out.append((label, t, places))
    return out


def brute(text):
    own, k, labels, score = words(text), license_scan.K, set(), 0.0
    phrases = [(p.split(), label) for p, label in license_scan.BASE.items()]
    base = [(n, label) for p, label in phrases for n in range(len(own)) if own[n : n + len(p)] == p]
    for label, t, places in indexed():
        votes = [(i, j) for i in range(len(own) - k + 1) for j in places.get(tuple(own[i : i + k]), [])]
        spans, last, diagonal = [], None, defaultdict(set)
        for i, j in votes:
            diagonal[i - j].add(j)
        for d in sorted(diagonal):
            if last is None or d - last > license_scan.SHIFT:
                spans.append(set())
            spans[-1] |= diagonal[d]
            last = d
        for js in spans:
            share = len({j + x for j in js for x in range(k)}) / len(t)
            score = max(score, share)
            if share >= license_scan.LEAST:
                labels.add(label)
    at = [n for n, _ in base]
    return len(own), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels | {x for _, x in base})), 1.0 if base else round(score, 9)


def test_scan_by_brute_force(spark):
    r, rows = random.Random(4), [None, "", "cc", "CC-BY", "é cc by ß"]
    fill = lambda n: " ".join(r.choice("the of any person software copy this license permission granted é words".split()) for _ in range(n))
    for _, text in license_scan.templates():
        own = text.split()
        rows.append(f"{fill(20)} {text} {fill(5)}")
        for change in range(3):
            w = list(own)
            for _ in range(1 + len(w) // 15):
                at = r.randrange(len(w))
                w[at : at + (change != 0)] = ["changed"] * (change != 1)  # put in, left out, replaced
            rows.append(f"{fill(3)} {' '.join(w)} {fill(9)} {' '.join(own[: len(own) // 2])}")
    rows.append(" ".join(t for _, t in license_scan.templates()) * 2)
    rows += [fill(400), "all rights reserved, " * 300 + "general public license"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, round(x.score, 9)) for x in license_scan.scan(docs).collect()}
    assert got == {n: brute(t) for n, t in enumerate(rows)}
    assert sum(x[5] != x[4] for x in got.values()) > 30


def test_whole_texts_and_own_templates(spark):
    whole = dict(zip(license_scan.WHOLE, license_scan.templates()[-len(license_scan.WHOLE) :]))
    docs = spark.createDataFrame([(n, text) for n, (_, text) in enumerate(whole.values())], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for n, (label, _) in enumerate(whole.values()):
        assert label in got[n].labels.split(",") and got[n].score == 1.0
    own = license_scan.scan(spark.createDataFrame([(1, "x may be used by all who ask for it first y")], "doc_id long, text string"), [("own", "may be used by all who ask for it first")]).first()
    assert (own.labels, own.score) == ("own", 1.0)


def test_the_filter_misses_no_run(spark):
    rows = license_scan._template_rows(license_scan.templates())
    keys = np.array([r[2] for r in rows], np.int64)
    found = license_scan.BoundedFilter.of(spark, keys)
    assert len(found.sent.value) <= 4 << 20 and found.may_hold(keys).all()
    assert found.may_hold(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200_000, dtype=np.int64)).mean() < 0.001

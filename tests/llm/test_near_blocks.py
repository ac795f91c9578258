"""Blocks of open groups: by members and by shingles, with long texts among them."""

import random

import pytest

from peakfold.llm import near_dedup


def crowd(seed, long):
    """Documents that share most of a passage but differ enough, near copies among them, and long ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3_000)}"
    passage, rows = [word() for _ in range(120)], []
    for n in range(70):
        text = list(passage)
        for _ in range(r.choice([1, 4, 9, 15])):
            text[r.randrange(len(text))] = word()
        rows.append((n, " ".join(text + [word() for _ in range(r.choice([0, 10, 30]))])))
    for n in range(100, 106):
        text = [f"l{i * 7 % 9_000}" for i in range(long)]
        for _ in range(long // 60 * (n - 99)):
            text[r.randrange(len(text))] = word()
        rows.append((n, " ".join(passage + text)))
    return rows


def plain(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("members, shingles", [(4, 1 << 18), (256, 500)])
def test_the_same_groups(spark, monkeypatch, members, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK", members)
    monkeypatch.setattr(near_dedup, "SHINGLES", shingles)
    # few bands, so that most pairs are left to the blocks
    rows = crowd(3, 4_000)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=3, percent=85, bands=60, rows=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, 3, 85)


def test_long_members_take_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHINGLES", 1_000)
    left = spark.createDataFrame([(1, n, 10 if n < 50 else 5_000, n, 0) for n in range(60)], "key long, node long, n long, comp long, most long")
    sets = spark.createDataFrame([(n, [n]) for n in range(60)], "node long, hashes array<long>")
    blocks = near_dedup._blocks(left, sets)
    each = blocks.join(left.select("node", "n"), "node").groupBy("i", "j", "one").agg({"n": "sum"}).toDF("i", "j", "one", "n").collect()
    assert blocks.select("i", "j").distinct().count() > 400 and max(r.n for r in each) <= 25_000
    pairs = blocks.alias("x").join(blocks.alias("y"), ["key", "i", "j"]).where("x.one and not y.one").selectExpr("x.node a", "y.node b").distinct().count()
    assert pairs == 59 * 60  # every member outside of the largest component meets every other

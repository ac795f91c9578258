"""Tables without copies."""

import pytest

from peakfold.llm import exact_dedup


@pytest.mark.parametrize("n", [1, 12, 3000])
def test_nothing_to_drop(spark, n, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 1000)
    docs = spark.createDataFrame([(i, f"text of its own number {i} with {i * i} and {i % 7}", "s") for i in range(n)], "doc_id long, text string, source string")
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == n and all(r.kept and r.group_size == 1 and r.keep_id == r.doc_id for r in got)
    assert exact_dedup.deduplicated(docs).count() == n


def test_one_shard_has_no_copies(spark, monkeypatch):
    """Copies in one shard of the index, none in the others."""
    monkeypatch.setattr(exact_dedup, "SHARD", 10)
    texts = [f"alone {i}" for i in range(60)] + ["twice"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert [i for i in got if not got[i].kept] == [60] and got[60].keep_id == 61 and got[61].group_size == 2


def test_filters_follow_their_entries():
    import numpy as np

    own = np.arange(5, dtype=np.int64) * 0x123456789ABCDEF
    small = exact_dedup._run_filter(own, 1 << 22)
    assert len(small) <= 60
    full = exact_dedup._run_filter(np.arange(1 << 16, dtype=np.int64) * 0x123456789ABCDEF, 1 << 16)
    assert len(full) == (1 << 16) // 8
    for data, bits, digests in ((small, 1 << 22, own), (full, 1 << 16, own)):
        assert set(np.concatenate(list(exact_dedup._bits(digests, bits))).tolist()) <= set(exact_dedup._set_bits(data, bits).tolist())

"""The pipeline on a small table, stage by stage."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, rows, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if n < 4:
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = Counter(r.doc_id for r in at.collect())
    assert set(range(40)) <= set(kept["language ID"]) and 300 not in kept["language ID"] and 304 not in kept["language ID"]
    assert kept["exact dedup"][205] == 1 and 200 not in kept["exact dedup"] and kept["exact dedup"][500] == 1
    assert [n for n in range(100, 106) if n in kept["near dedup"]] == [100]
    assert max(kept["mixing"].values()) <= 4 and sum(kept["byte-level BPE"].values()) == sum(kept["mixing"].values())
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(i or -1 for i in kept["byte-level BPE"].elements())

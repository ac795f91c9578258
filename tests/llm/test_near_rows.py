"""Near copies whose ids do not tell them apart."""

from peakfold.llm import near_dedup


def test_near_copies_that_share_an_id_or_have_none(spark):
    """One document of each group stays, whatever the ids."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    rows = [(3, a), (5, "quite another text with words of its own"), (5, a + " more"), (None, b), (None, b + " more"), (None, b + " other"), (None, c)]
    rows += [(7, "x y z one two three four"), (7, "x y z one two three four"), (8, None), (8, ""), (None, "")]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 8
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id and r.text) == [(3, a), (5, rows[1][1]), (7, rows[7][1])]
    assert sorted((r.text or "")[:1] for r in got if r.doc_id is None) == ["", "b", "c"] and sum(r.doc_id == 8 for r in got) == 2


def test_any_column_names(spark):
    """The operators that pass rows on take columns of any name."""
    from pyspark.sql import functions as F

    from peakfold.llm import exact_dedup, language_id, mixing

    names = "_id _key _pf_key _tie _times _copy _sha _kept _rows key id sha a b doc copy at own n times tie group node comp kept lang_pred row batch _deal".split()
    docs = spark.createDataFrame([(1, "the same words stand here and here again", "en", "s"), (2, "the same words stand here and here again", "en", "s"), (3, "other words of the text are there", "en", "t")] * 2, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for stage, rows in ((exact_dedup.deduplicated, 2), (near_dedup.deduplicated, 2), (language_id.in_language, 6)):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() == rows and out.first()["_key"] == "_key"
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(docs).count() >= 3

"""The offers during which virtual time 1 passes, against the SQL that queues them word by word."""

import random

import duckdb
import pyarrow as pa
import pytest

from peakfold.llm import mixing

COLS = ["doc_id", "size", "source_size", "target", "taken", "virtual_finish"]


def same_as_sql(spark, rows):
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": pa.array([r[2] for r in rows], pa.string())})
    c = duckdb.connect()
    c.register("documents", table)
    want = sorted(c.execute(f"SELECT {', '.join(COLS)} FROM ({mixing.OP1_SQL})").fetchall())
    got = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select(COLS).collect()))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3]) and (a[5] == pytest.approx(b[5]) if b[5] is not None else a[5] is None)


def test_many_sources(spark):
    r = random.Random(1)
    rows = [(n, "w " * r.choice([0, 1, 2, 3, 7, 40]), f"s{r.randint(0, 150)}" if n % 19 else None) for n in range(900)]
    same_as_sql(spark, rows)


def test_one_hot_source_and_single_documents(spark):
    r = random.Random(2)
    rows = [(n, "w " * r.randint(1, 9), "hot") for n in range(400)] + [(500 + n, "x " * (n + 1), f"one{n}") for n in range(20)]
    same_as_sql(spark, rows)


def test_very_long_texts_are_no_rows_of_words(spark):
    rows = [(n, "word " * 200_000, f"s{n}") for n in range(3)] + [(10 + n, "few words here", f"s{n % 3}") for n in range(9)]
    same_as_sql(spark, rows)


def test_the_edges_stay_few(spark):
    rows = [(1, "w " * 1_000_000, "a"), (2, "w " * 10, "b"), (3, "w w w", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    offers = spark.createDataFrame([(0, 0, "=a", "d", 1, 1_000_000, 0, 700_000.5), (1, 0, "=b", "d", 2, 10, 0, 6.7), (2, 0, "=c", "d", 3, 3, 0, 2.2)], "row long, pass int, key string, draw string, doc_id long, size long, start long, target double")
    units = mixing._edges(offers).collect()
    assert len(units) < 40 and sum(u.words for u in units if u.words > 1) == 700_000 + 6 + 2
    assert sum(r.taken for r in mixing.mix(df).collect()) == round(1.5 * 1_000_013)

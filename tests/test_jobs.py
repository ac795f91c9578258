"""The jobs: whole results, repeated runs, growing input, the command lines."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import entries, formula_index, run_report

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
INDEX = {"least_atoms": 2, "files_per_trigger": 2, "files_per_source": 2}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HAND = [
    (1, "The ion of C8H10N4O2 was seen, C8H10N4O2 again, and NaCl.", "en", "s0", 1), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, "Caffeine; XyZ2 C99999H I N (CH3)2CO", "en", None, 9),
    (None, "H2O\tand FeÉ CO2", "de", "s0", 3), (5, "FeS2 FeS2", "de", "a b/c=1", 3), (5, "FeS2 FeS2", "de", "a b/c=1", 3),
]


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [x if not isinstance(x, float) else pytest.approx(x, rel=1e-9, abs=1e-9) for x in a] == list(b)


def by_sql(name, folder):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = c.execute(entries.SQL[name])
    cols = [x[0] for x in got.description]
    return sorted((tuple(r[cols.index(x)] for x in sorted(cols)) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_equal_to_sql(spark, name):
    close(rows(entries.QUERIES[name](spark, str(DATA))), by_sql(name, DATA))


def test_report_is_replaced_as_a_whole(spark, tmp_path):
    config = json.loads(run_report.CONFIG.read_text())
    tables, out = tmp_path / "tables", str(tmp_path / "out")
    shutil.copytree(DATA, tables)
    before = run_report.run(spark, str(tables), out, config)
    first, work = rows(run_report.report(spark, out)), rows(run_report.worklist(spark, out))
    assert before["spectra written"] == before["spectra read"] == len(work) and before["runs written"] == len(first) == 40
    again = run_report.run(spark, str(tables), out, config)
    assert again == before and rows(run_report.report(spark, out)) == first and rows(run_report.worklist(spark, out)) == work
    few = spark.read.parquet(str(DATA / "part.parquet")).where("p_partkey % 40 < 3 AND p_partkey < 100")
    few.write.parquet(str(tmp_path / "few.parquet"))
    (tables / "part.parquet").unlink()
    shutil.copytree(tmp_path / "few.parquet", tables / "part.parquet")
    less = run_report.run(spark, str(tables), out, config)
    assert less["runs written"] == 3 and less["spectra written"] == few.count()
    assert {r["recommendation"] for r in run_report.worklist(spark, out).select("recommendation").distinct().collect()} <= {"ml", "classical", "hybrid"}


def test_work_list_files_grow_in_number(spark, tmp_path):
    run_report.run(spark, str(DATA), str(tmp_path / "o"), {"least_spectra": 5, "rows_per_file": 20})
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "o" / "worklist").rglob("*.parquet")]
    assert len(sizes) >= 5 and max(sizes) < 60 and sum(sizes) == spark.read.parquet(str(DATA / "part.parquet")).count()


def test_report_leaves_no_tables_behind(spark, tmp_path):
    from peakfold.operators.tables import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    run_report.run(spark, str(DATA), str(tmp_path / "out"), json.loads(run_report.CONFIG.read_text()))
    assert set(os.listdir(folder)) == before


def test_tables_without_rows(spark, tmp_path):
    for name in ("part", "lineitem"):
        spark.read.parquet(str(DATA / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"t/{name}.parquet"))
    counts = run_report.run(spark, str(tmp_path / "t"), str(tmp_path / "o"), {"least_spectra": 1, "rows_per_file": 50})
    assert set(counts.values()) == {0}


def test_index_by_hand(spark, tmp_path):
    spark.createDataFrame(HAND, DOCS).write.parquet(str(tmp_path / "d"))
    args = (str(tmp_path / "d"), str(tmp_path / "o"), str(tmp_path / "c"), INDEX)
    formula_index.run(spark, *args)
    got = formula_index.indexed(spark, str(tmp_path / "o"))
    seen = sorted((str(r["doc_id"]), r["formula"], r["n_mentions"], r["first_word"], r["n_atoms"], r["source"]) for r in got.collect())
    assert seen == [
        ("1", "C8H10N4O2", 2, 3, 24, "s0"), ("1", "NaCl", 1, 9, 2, "s0"), ("4", "CH3", 1, 5, 4, None), ("5", "FeS2", 2, 0, 3, "a b/c=1"), ("5", "FeS2", 2, 0, 3, "a b/c=1"),
        ("None", "CO2", 1, 3, 3, "s0"), ("None", "H2O", 1, 0, 3, "s0"),
    ]
    caffeine = got.where("formula = 'C8H10N4O2'").first()
    assert caffeine["mass"] == pytest.approx(194.080376, abs=1e-5) and caffeine["mh_mz"] == pytest.approx(195.0877, abs=1e-3) and caffeine["m1"] == pytest.approx(0.103, abs=0.01)


def test_index_grows_by_what_is_new(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    parts = docs.randomSplit([1.0, 1.0, 1.0, 1.0], seed=3)
    where, out, check = str(tmp_path / "d"), str(tmp_path / "o"), str(tmp_path / "c")
    taken = []
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(where)
    taken.append(formula_index.run(spark, where, out, check, INDEX))
    files = sorted(str(p) for p in Path(out, "mentions").rglob("*.parquet"))
    taken.append(formula_index.run(spark, where, out, check, INDEX))
    assert sorted(str(p) for p in Path(out, "mentions").rglob("*.parquet")) == files
    for part in parts[2:]:
        part.repartition(2).write.mode("append").parquet(where)
    taken.append(formula_index.run(spark, where, out, check, INDEX))
    assert set(files) < {str(p) for p in Path(out, "mentions").rglob("*.parquet")}
    assert [t["documents read"] for t in taken] == [parts[0].count() + parts[1].count(), 0, parts[2].count() + parts[3].count()]
    assert taken[0]["mentions in the index"] == taken[1]["mentions in the index"] < taken[2]["mentions in the index"]
    formula_index.run(spark, str(DATA / "documents.parque[t]"), str(tmp_path / "o2"), str(tmp_path / "c2"), INDEX)
    for read in (lambda o: formula_index.indexed(spark, o), lambda o: formula_index.totals(spark, o)):
        assert rows(read(out)) == rows(read(str(tmp_path / "o2")))


def test_index_after_a_run_that_was_cut_short(spark, tmp_path, monkeypatch):
    """The stream stops at a file that cannot be read; once that is mended, the rest is taken, nothing twice."""
    docs = spark.createDataFrame(HAND, DOCS)
    where, out, check = tmp_path / "d", str(tmp_path / "o"), str(tmp_path / "c")
    for k in range(3):
        docs.where(f"pmod(hash(text), 3) = {k}").coalesce(1).write.mode("append").parquet(str(where))
    config = INDEX | {"files_per_trigger": 1}
    last = sorted(where.glob("*.parquet"), key=os.path.getmtime)[-1]
    held = last.read_bytes()
    last.write_bytes(held[:40])
    with pytest.raises(Exception):
        formula_index.run(spark, str(where), out, check, config)
    last.write_bytes(held)
    for crc in where.glob(".*.crc"):
        crc.unlink()
    formula_index.run(spark, str(where), out, check, config)
    formula_index.run(spark, str(tmp_path / "d"), str(tmp_path / "o2"), str(tmp_path / "c2"), INDEX)
    assert rows(formula_index.indexed(spark, out)) == rows(formula_index.indexed(spark, str(tmp_path / "o2")))


@pytest.mark.parametrize("job", ["run_report", "formula_index"])
def test_command_lines(job, tmp_path):
    given = ["--tables", str(DATA)] if job == "run_report" else ["--documents", str(DATA / "documents.parque[t]"), "--checkpoint", str(tmp_path / "c")]
    config = tmp_path / "config.json"
    config.write_text((ROOT / f"jobs/{job}.json").read_text())
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    for _ in range(2 if job == "formula_index" else 1):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--out", str(tmp_path / "o"), "--config", str(config)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert ("documents read: 0" if job == "formula_index" else "runs written: 40") in done.stderr
    assert list(tmp_path.glob("o/*/*=*/*.parquet"))

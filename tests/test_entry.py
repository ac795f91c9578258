"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 40 and "library_search_topk" in found


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and got.columns[0] == "rank"


def test_rest_stands_without_the_llm_folders(tmp_path):
    code = f"""
import shutil, sys
shutil.copytree({str(ROOT)!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__'))
sys.path.insert(0, {str(tmp_path / 'r')!r})
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and 'library_search_topk' in e.queries() and not any(n.startswith('op') for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path)

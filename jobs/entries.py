"""The jobs as queries, and their SQL."""

from __future__ import annotations

from . import formula_index, run_report

QUERIES = {"job1_run_report": run_report.job1, "job2_formula_index": formula_index.job2}
SQL = {"job1_run_report": run_report.JOB1_SQL, "job2_formula_index": formula_index.JOB2_SQL}

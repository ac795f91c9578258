"""The jobs table with many jobs: what a status reads, and compaction."""

import datetime as dt
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from peakfold.operators.jobs import COMPLETED, FAILED, PENDING, RUNNING, Jobs

FIELDS = ["job_id", "params", "state", "result", "error", "ts"]


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """1,000 jobs: done, failed, running and waiting ones."""
    folder, ids = tmp_path_factory.mktemp("jobs"), {}
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for n in range(1_000):
        job = str(uuid.UUID(int=n + 1))
        ids[job] = states = [[PENDING, RUNNING, COMPLETED], [PENDING, RUNNING, FAILED], [PENDING, RUNNING], [PENDING]][n % 4]
        place = folder / f"jobs/job_id={job}/{uuid.uuid4().hex}"
        os.makedirs(place)
        rows = [(job, "p", s, f"r{n}" if s == COMPLETED else None, "no luck" if s == FAILED else None, at) for s in states]
        kinds = [pa.string()] * 5 + [pa.timestamp("us", "UTC")]
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], FIELDS), place / "part-0.parquet")
    return str(folder), ids


def test_one_status_reads_one_job(spark, many):
    folder, ids = many
    jobs = Jobs(spark, folder)
    for job in list(ids)[:4]:
        assert len(jobs._rows(f"jobs/job_id={job}").inputFiles()) == 1
        assert jobs.status(job)["state"] == ids[job][-1]


def test_compaction_keeps_every_state(spark, many):
    folder, ids = many
    jobs = Jobs(spark, folder)
    before = sorted(map(tuple, jobs.table().collect()), key=str)
    assert jobs.compact() == 500 and jobs.compact() == 0
    assert len(os.listdir(f"{folder}/jobs")) == 500
    assert len([f for _, _, fs in os.walk(f"{folder}/history") for f in fs if f.endswith(".parquet")]) == 1
    assert sorted(map(tuple, jobs.table().collect()), key=str) == before
    for n in (0, 1, 2, 3, 996, 997):
        job = list(ids)[n]
        found = jobs.status(job)
        assert found["state"] == ids[job][-1]
        assert found.get("result") == (f"r{n}" if ids[job][-1] == COMPLETED else None) and found.get("error") == ("no luck" if ids[job][-1] == FAILED else None)
    assert jobs.status(str(uuid.uuid4()))["state"] == "UNKNOWN"


def test_rows_in_both_places_count_once(spark, tmp_path):
    """As after a crash between the writing of the history and the removal of what it holds."""
    jobs = Jobs(spark, str(tmp_path))
    job = jobs.dispatch(lambda: spark.range(3), "p")
    jobs.wait(job, 60)
    while jobs.status(job)["state"] != COMPLETED:
        pass
    rows = jobs.table().count()
    jobs._rows("jobs").write.parquet(str(tmp_path / "history" / "x"))
    assert jobs.table().count() == rows == 3 and jobs.status(job)["state"] == COMPLETED
    assert jobs.compact() == 1 and jobs.table().count() == rows and jobs.result(job).count() == 3

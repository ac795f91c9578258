"""Searches as jobs: dispatched at once, run in threads, states and results kept as tables."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "job_id string, params string, state string, result string, error string, ts timestamp"
MOST_AT_ONCE = 10_000  # jobs that one compaction moves
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"


class Jobs:
    """A jobs table in a folder.  Every change of state appends a row, so what happened outlives the
    process; the latest row of a job is its state.  The rows of a job lie in a folder of its own, so a
    status reads these and no other, however many jobs there are; :meth:`compact` moves what is over
    to a history in few files.  Results are tables beside it."""

    def __init__(self, spark: SparkSession, folder: str, threads: int = 4):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pool = ThreadPoolExecutor(threads, thread_name_prefix="search")
        self.futures: dict[str, Future] = {}
        self.cancelled: set[str] = set()

    def _note(self, job_id: str, params: str, state: str, result: str | None = None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(job_id, params, state, result, error)], "job_id string, params string, state string, result string, error string")
        row.withColumn("ts", F.current_timestamp()).coalesce(1).write.parquet(f"{self.folder}/jobs/job_id={job_id}/{uuid.uuid4().hex}")  # a folder of its own: two writers of one would undo each other

    def dispatch(self, work: Callable[[], DataFrame], params: str = "") -> str:
        """Note the job and return its id; ``work`` makes the result in another thread, under a tag of
        the job's id by which its Spark stages can be stopped."""
        job_id = str(uuid.uuid4())
        self._note(job_id, params, PENDING)
        self.futures[job_id] = self.pool.submit(self._run, job_id, params, work)
        self.futures[job_id].add_done_callback(lambda _: self.futures.pop(job_id, None))
        return job_id

    def _run(self, job_id: str, params: str, work: Callable[[], DataFrame]) -> None:
        self.spark.sparkContext.addJobTag(job_id)
        self.spark.sparkContext.setJobDescription(f"{params or 'job'} ({job_id})")
        try:
            if job_id in self.cancelled:
                raise InterruptedError("cancelled before it started")
            self._note(job_id, params, RUNNING)
            path = f"{self.folder}/results/{job_id}"
            work().write.parquet(path)
            self._note(job_id, params, COMPLETED, result=path)
        except Exception:
            self.spark.sparkContext.removeJobTag(job_id)  # the note is not to be interrupted as well
            if job_id in self.cancelled:
                self._note(job_id, params, CANCELLED)
            else:
                self._note(job_id, params, FAILED, error=traceback.format_exc())
        finally:
            self.spark.sparkContext.removeJobTag(job_id)
            self.spark.sparkContext.setLocalProperty("spark.job.description", None)

    def cancel(self, job_id: str) -> None:
        """Stop a job's stages, or keep it from starting; it is noted as cancelled unless it is done."""
        self.cancelled.add(job_id)
        self.spark.sparkContext.cancelJobsWithTag(job_id)

    def table(self) -> DataFrame:
        """Every row of every job; those that are in both places for a moment, once."""
        return self._rows("jobs").unionByName(self._rows("history")).distinct()

    def _rows(self, part: str) -> DataFrame:
        """The rows under a folder, none if it is not there."""
        try:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{part}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def compact(self, files: int = 1) -> int:
        """Move the rows of all jobs that are over to the history; their number.  The history is written
        first, so whoever reads in between, or after a crash in between, sees them twice and not never;
        another compaction then takes the rest.  One process at a time may do this."""
        rows = self._rows("jobs")
        over = rows.groupBy("job_id").agg(F.max(F.col("state").isin(PENDING, RUNNING) == F.lit(False)).alias("over")).where("over").select("job_id")
        ids = [r["job_id"] for r in over.limit(MOST_AT_ONCE).collect()]
        if not ids:
            return 0
        done = self.spark.createDataFrame([(i,) for i in ids], "job_id string")
        rows.join(F.broadcast(done), "job_id").select(rows.columns).coalesce(files).sortWithinPartitions("job_id").write.parquet(f"{self.folder}/history/{uuid.uuid4().hex}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for i in ids:
            fs.delete(path(f"{self.folder}/jobs/job_id={i}"), True)
        return len(ids)

    def status(self, job_id: str) -> dict:
        """state (UNKNOWN for an id that is none or that no job has), result path, error, message."""
        try:
            job_id = str(uuid.UUID(job_id))
        except ValueError:
            return {"state": "UNKNOWN", "message": f"'{job_id}' is not a job id"}
        rank = F.when(F.col("state") == PENDING, 0).when(F.col("state") == RUNNING, 1).otherwise(2)
        last = F.max_by(F.struct("state", "result", "error"), F.struct(rank, "ts")).alias("s")
        row = None
        try:
            for part in (f"jobs/job_id={job_id}", "history"):  # its own folder, or else what is over
                row = row or self._rows(part).where(F.col("job_id") == job_id).agg(last).first()["s"]
        except Exception as e:
            return {"state": "UNAVAILABLE", "message": f"the jobs table cannot be read: {e}"}
        if row is None:
            return {"state": "UNKNOWN", "message": f"no job has the id {job_id}"}
        says = {PENDING: "waits to start", RUNNING: "is running", COMPLETED: "is done", FAILED: "failed", CANCELLED: "was cancelled"}
        return {"state": row["state"], "result": row["result"], "error": row["error"], "message": f"job {job_id} {says.get(row['state'], 'is in an unexpected state')}"}

    def result(self, job_id: str) -> DataFrame:
        found = self.status(job_id)
        if found["state"] != COMPLETED:
            raise ValueError(found["message"])
        return self.spark.read.parquet(found["result"])

    def wait(self, job_id: str, timeout: float | None = None) -> None:
        future = self.futures.get(job_id)
        if future is not None:
            future.result(timeout)

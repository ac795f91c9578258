"""Slim intermediate tables in the session's shared folder: what several branches of a plan read is made once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset and all executors are on this machine, as in
    tests, a folder of our own that goes when the process ends; an error on a cluster, whose executors
    would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        path = tempfile.mkdtemp(prefix="peakfold-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own["dir"] = "file://" + path
    return _own["dir"]


def clean(spark: SparkSession, *kinds: str) -> None:
    """Delete the tables that operators have left in the shared folder; those whose results are still to
    be stored must be left out by naming the other ``kinds`` (``core``, ``spectra``, ``llm``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for kind in kinds or ("core", "spectra", "llm"):
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f"{kind}-*")) or []:
            fs.delete(status.getPath(), True)


@contextmanager
def scratch(spark: SparkSession):
    """The tables that :func:`materialized` writes within go at the end; what is read from them must be
    stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back.  Lineage ends here, so a lost executor costs a read."""
    path = f"{shared_dir(df.sparkSession)}/core-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

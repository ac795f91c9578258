"""Spectra files as a stream: an extension, over the same functions as the batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import score_library
from ..sources.files import mgf_rows


def watch_mgf(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Spectra of the MGF files that arrive in a folder, as a streaming DataFrame."""
    text = spark.readStream.option("lineSep", "END IONS").option("maxFilesPerTrigger", files_each).text(folder)
    return text.where(F.col("value").contains("BEGIN IONS")).select(*mgf_rows(F.regexp_replace("value", "\r", "")))


def score_stream(query: DataFrame, spectra: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Score arriving spectra against one query and append the scores to a table; exactly once, as the
    file sink and the checkpoint see to it."""
    scored = score_library(query, spectra)
    writer = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Quality report of every acquisition run, and the search each spectrum should go to.

    python -m jobs.run_report --tables DIR --out DIR [--config FILE]

Reads the tables of spectra and peaks (``part.parquet``, ``lineitem.parquet``), measures every spectrum,
rolls the metrics up by run, grades the runs, and writes

* ``OUT/report``: a row for each run, partitioned by recommendation;
* ``OUT/worklist``: id, run_id, snr, n_peaks, is_chimeric of every spectrum, partitioned by the
  recommendation of its run, for the searches that follow.

A run of the job replaces both tables as a whole, so the job can be repeated at any time.  Sums of
doubles depend on their order in the last digits; the report is rounded to nine.
"""

from __future__ import annotations

import argparse
import json
import logging
import math
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.operators import qc
from peakfold.operators.tables import materialized, scratch, shared_dir
from peakfold.plans.queries import METRIC_SQL, POINTS_SQL, TOTALS_SQL, VERDICT_SQL
from peakfold.sources import views

log = logging.getLogger("jobs.run_report")
CONFIG = Path(__file__).with_suffix(".json")
ROUNDED = ["mean_snr", "median_snr", "pct_low_snr", "pct_high_snr", "mean_peaks", "median_peaks", "std_peaks", "pct_sparse", "pct_dense", "pct_chimeric", "mean_co_isolated"]
REPORT = (
    f"run_id long, n_spectra long, {', '.join(f'{c} double' for c in ROUNDED)}, n_chimeric long, richness int, snr_grade string, density_grade string, chimericity_grade string, "
    "score_classical int, score_ml int, reliable boolean, recommendation string"
)
WORK = "id long, run_id long, snr double, n_peaks int, is_chimeric boolean, recommendation string"
COLUMNS = [c.split()[0] for c in REPORT.split(", ")]


def run(spark: SparkSession, tables: str, out: str, config: dict) -> dict[str, int]:
    """Write both tables; the numbers of rows read and written.

    ``config``: ``least_spectra``, below which a run is marked as not reliable; ``rows_per_file`` of the
    work list, about, so that its files grow in number and not in size.  A run without any peaks has null ratios and is graded by what
    is there; runs may hold any share of the spectra.
    """
    with scratch(spark):
        rows = materialized(qc.metrics(views.library(spark, tables), keep=("run_id",)), "metrics")
        graded = qc.graded(qc.summary(rows, by=("run_id",)))
        runs = graded.withColumns({c: F.round(c, 9) for c in ROUNDED}).withColumn("reliable", F.col("n_spectra") >= config["least_spectra"]).select(COLUMNS)
        runs.repartition("recommendation").write.mode("overwrite").partitionBy("recommendation").parquet(f"{out}/report")
        # one row for each run: a side that Spark broadcasts if it is small, and against which it splits hot runs if not
        verdict = report(spark, out).select(F.col("run_id").alias("_run"), "recommendation")
        work = rows.join(verdict, F.col("run_id").eqNullSafe(F.col("_run"))).select("id", "run_id", F.round("snr", 9).alias("snr"), "n_peaks", "is_chimeric", "recommendation")
        files = math.ceil(rows.count() / config["rows_per_file"])
        work.repartition(max(files, 1), F.xxhash64("recommendation", F.pmod(F.xxhash64("id"), F.lit(max(files, 1))))).write.mode("overwrite").partitionBy("recommendation").parquet(f"{out}/worklist")
    counts = {
        "spectra read": views.read(spark, tables, "part").count(), "peaks read": views.read(spark, tables, "lineitem").count(),
        "runs written": report(spark, out).count(), "spectra written": worklist(spark, out).count(),
    }
    for what, n in counts.items():
        log.info("%s: %d", what, n)
    return counts


def report(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{out}/report")


def worklist(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(WORK).parquet(f"{out}/worklist")


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as they stand after two runs into one folder: the work list, each spectrum with its run's row."""
    out = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, out, json.loads(CONFIG.read_text()))
    runs = report(spark, out).drop("recommendation").withColumnRenamed("run_id", "_run")
    return worklist(spark, out).join(runs, F.col("run_id").eqNullSafe(F.col("_run"))).drop("_run")


JOB1_SQL = f"""WITH {METRIC_SQL}, runs AS (SELECT run_id, {TOTALS_SQL} FROM metrics GROUP BY run_id), points AS (SELECT *, {POINTS_SQL} FROM runs)
SELECT m.id, run_id, round(m.snr, 9) AS snr, m.n_peaks, m.is_chimeric, n AS n_spectra, {", ".join(f"round({c}, 9) AS {c}" for c in ROUNDED)}, n_chimeric, richness,
  CASE WHEN pct_low_snr > 30 THEN 'POOR' WHEN pct_low_snr > 10 THEN 'FAIR' ELSE 'GOOD' END AS snr_grade,
  CASE WHEN pct_sparse > 20 THEN 'SPARSE' WHEN pct_dense > 20 THEN 'DENSE' ELSE 'NORMAL' END AS density_grade,
  CASE WHEN pct_chimeric > 25 THEN 'HIGH' WHEN pct_chimeric > 10 THEN 'MODERATE' ELSE 'LOW' END AS chimericity_grade,
  score_classical, score_ml, n >= {json.loads(CONFIG.read_text())["least_spectra"]} AS reliable, {VERDICT_SQL} FROM points JOIN metrics m USING (run_id)"""


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--tables", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--config", default=str(CONFIG))
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("run report").getOrCreate()
    try:
        run(spark, given.tables.rstrip("/"), given.out.rstrip("/"), json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

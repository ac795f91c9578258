"""Index of the chemical formulas that texts mention, with their masses, kept up to date.

    python -m jobs.formula_index --documents PATH --out DIR --checkpoint DIR [--config FILE]

Takes the document files that are new since the last run (a file stream with a checkpoint), finds the
words that are formulas of the known elements, computes their isotope pattern and the m/z of their
protonated ion, and writes

* ``OUT/mentions``: a row for each document and formula, partitioned by source, by Spark's file sink,
  whose log keeps every file of documents in the index exactly once;
* ``OUT/formulas``: a row for each formula, over all mentions as they stand, replaced at the end of
  each run.

A run without new files leaves the index as it is; a run that was cut short is taken up where its
checkpoint says.  Both folders belong together: a new checkpoint needs a new ``OUT``.
"""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.functions.chem import elements, ion_mz, isotope_columns
from peakfold.functions.dims import ADDUCTS, ISOTOPES
from peakfold.operators.tables import shared_dir

log = logging.getLogger("jobs.formula_index")
CONFIG = Path(__file__).with_suffix(".json")
#: Words are runs of letters and digits; a formula's numbers have four digits at most.
WORD, FORMULA = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"^([A-Z][a-z]?[0-9]{0,4})+$"
MENTION = "doc_id long, formula string, n_mentions long, first_word long, n_atoms long, mass double, m1 double, m2 double, mh_mz double, source string"
TOTAL = "formula string, mass double, mh_mz double, n_documents long, n_mentions long"
PROTONATED = next(a for a in ADDUCTS if a[0] == "[M+H]+")


def mentions(docs: DataFrame, least_atoms: int) -> DataFrame:
    """A row for each document and formula in its text: doc_id, formula, n_mentions, first_word (from 0),
    n_atoms, mass, m1, m2, mh_mz, source.

    Every column comes from the row itself, by JVM expressions, so nothing is shuffled and the same
    plan runs on a stream.  Null and empty texts mention nothing; rows that repeat are each indexed.
    """
    words = docs.select("doc_id", "source", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    kept = words.withColumn("found", F.filter("words", lambda w: w.rlike(FORMULA)))
    one = kept.where(F.size("found") > 0).select("doc_id", "source", "words", "found", F.explode(F.array_distinct("found")).alias("formula"))
    atoms = F.aggregate(elements(F.col("formula")), F.lit(0).cast("bigint"), lambda s, e: s + e["n"])
    f = F.col("formula")
    rows = one.select(
        F.col("doc_id").cast("long").alias("doc_id"), "formula", F.size(F.filter("found", lambda w: w == f)).cast("long").alias("n_mentions"),
        (F.array_position("words", f) - 1).cast("long").alias("first_word"), atoms.alias("n_atoms"), isotope_columns(f).alias("iso"), "source",
    )
    ion = ion_mz(F.col("iso.mass"), F.lit(float(PROTONATED[1])), F.lit(PROTONATED[2]))
    rounded = [F.round(c, 9).alias(n) for c, n in ((F.col("iso.mass"), "mass"), (F.col("iso.m1"), "m1"), (F.col("iso.m2"), "m2"), (ion, "mh_mz"))]
    return rows.where(F.col("iso").isNotNull() & (F.col("n_atoms") >= least_atoms)).select("doc_id", "formula", "n_mentions", "first_word", "n_atoms", *rounded, "source")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Index what is new in ``documents``, a folder or glob of Parquet files with doc_id, text and source;
    the numbers of rows read and written.

    ``config``: ``least_atoms`` of a formula; ``files_per_trigger`` of documents in a batch;
    ``files_per_source``, into which the mentions of a source are dealt in each batch, so that neither
    many small files nor one task for a large source come out.
    """
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_trigger"])
    found = mentions(source.parquet(documents), config["least_atoms"])
    dealt = found.repartition("source", F.pmod(F.xxhash64("doc_id"), F.lit(config["files_per_source"])))
    stream = dealt.writeStream.format("parquet").partitionBy("source").option("path", f"{out}/mentions").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    read = sum(p["numInputRows"] for p in stream.recentProgress)
    index = indexed(spark, out)
    rolled = index.groupBy("formula").agg(F.first("mass").alias("mass"), F.first("mh_mz").alias("mh_mz"), F.count("*").alias("n_documents"), F.sum("n_mentions").alias("n_mentions"))
    rolled.write.mode("overwrite").parquet(f"{out}/formulas")
    counts = {"documents read": read, "mentions in the index": index.count(), "formulas in the index": totals(spark, out).count()}
    for what, n in counts.items():
        log.info("%s: %d", what, n)
    return counts


def indexed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MENTION).parquet(f"{out}/mentions")


def totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TOTAL).parquet(f"{out}/formulas")


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as they stand after two runs into one folder: the mentions, each with its formula's numbers."""
    base = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        # a glob, as a file stream takes no plain path of a single file
        run(spark, f"{sf_dir}/documents.parque[t]", f"{base}/out", f"{base}/checkpoint", json.loads(CONFIG.read_text()))
    both = totals(spark, f"{base}/out").select("formula", F.col("n_documents").alias("all_documents"), F.col("n_mentions").alias("all_mentions"))
    return indexed(spark, f"{base}/out").join(both, "formula")


_KNOWN = ", ".join(f"('{e}', {iso[0][0]!r}::DOUBLE, {(iso[1][1] / iso[0][1] if len(iso) > 1 else 0.0)!r}::DOUBLE, {(iso[2][1] / iso[0][1] if len(iso) > 2 else 0.0)!r}::DOUBLE)" for e, iso in ISOTOPES.items())
JOB2_SQL = rf"""SELECT *, count(*) OVER (PARTITION BY formula) AS all_documents, (sum(n_mentions) OVER (PARTITION BY formula))::BIGINT AS all_mentions FROM (WITH known(element, mass, p1, p2) AS (VALUES {_KNOWN}),
split AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
found AS (SELECT doc_id, source, words, list_filter(words, lambda w: regexp_matches(w, '{FORMULA}')) AS hits FROM split),
each_ AS (SELECT doc_id, source, words, hits, unnest(list_distinct(hits)) AS formula FROM found WHERE len(hits) > 0),
asked AS (SELECT DISTINCT formula FROM each_),
tokens AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) AS digits FROM asked),
sums AS (
  SELECT formula, sum(n)::BIGINT AS n_atoms, sum(n * mass) AS mass, sum(n * p1) AS p1, sum(n * p2) AS p2, count(*) AS n, count(mass) AS n_known
  FROM (SELECT formula, element, CASE WHEN digits = '' THEN 1 ELSE digits::BIGINT END AS n FROM tokens) LEFT JOIN known USING (element) GROUP BY formula)
SELECT doc_id, formula, len(list_filter(hits, lambda w: w = formula))::BIGINT AS n_mentions, list_position(words, formula)::BIGINT - 1 AS first_word, n_atoms,
  round(mass, 9) AS mass, round(p1, 9) AS m1, round(p1 * p1 / 2 + p2, 9) AS m2, round((mass + {float(PROTONATED[1])!r}::DOUBLE) / {abs(PROTONATED[2])}, 9) AS mh_mz, source
FROM each_ JOIN sums USING (formula) WHERE n = n_known AND n_atoms >= {json.loads(CONFIG.read_text())["least_atoms"]})"""


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=str(CONFIG))
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("formula index").getOrCreate()
    try:
        run(spark, given.documents.rstrip("/"), given.out.rstrip("/"), given.checkpoint.rstrip("/"), json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

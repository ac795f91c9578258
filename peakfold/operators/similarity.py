"""Comparing peak lists: pairs, candidates within a tolerance, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import embedding, get_embedder
from ..functions.peaks import TOLERANCE, greedy_match, list_error, mz_bin, vector_cosine

METHODS = ("classical", "dreams", "lsm-ms2")


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"scoring_method must be one of {', '.join(METHODS)}, not {method!r}")


def compare(pairs: DataFrame, method: str = "classical", tolerance: float = TOLERANCE) -> DataFrame:
    """Adds to rows with ``query`` and ``reference`` peak lists: score, n_matched, n_query, n_ref,
    pct_matched, pct_ref_used, unmatched, error.  Narrow: no row leaves its partition.  The counts of
    matches and the unmatched peaks are null for embeddings."""
    check_method(method)
    if not 0 < tolerance <= 1:
        raise ValueError("tolerance must be above 0 and at most 1")
    bad = F.coalesce(list_error(F.col("query"), "Query"), list_error(F.col("reference"), "Reference"))
    rows = pairs.withColumns({"error": bad, "n_query": F.size("query"), "n_ref": F.size("reference")})
    if method == "classical":
        rows = rows.withColumn("_m", F.when(F.col("error").isNull(), greedy_match(F.col("query"), F.col("reference"), tolerance)))
        rows = rows.withColumns({"score": F.col("_m.score"), "n_matched": F.col("_m.n"), "unmatched": F.col("_m.unmatched")})
    else:
        embed = embedding(method)
        rows = rows.withColumns({"_q": embed("query"), "_r": embed("reference")})
        rows = rows.withColumns({"error": F.coalesce("error", "_q.error", "_r.error"), "score": F.when(F.col("error").isNull(), vector_cosine(F.col("_q.vector"), F.col("_r.vector")))})
        rows = rows.withColumns({"n_matched": F.lit(None).cast("int"), "unmatched": F.lit(None).cast("array<struct<mz:double,intensity:double>>")})
    rows = rows.withColumns({"pct_matched": F.col("n_matched") / F.col("n_query") * 100, "pct_ref_used": F.col("n_matched") / F.col("n_ref") * 100})
    return rows.drop("_m", "_q", "_r")


def tolerance_candidates(query: DataFrame, peaks: DataFrame, tolerance: float = TOLERANCE, width: float = 0.5) -> DataFrame:
    """All pairs of a query peak (q_mz, q_intensity) and a peak (spectrum_id, mz, intensity) with mz in
    q_mz - tol .. q_mz + tol.  An equi-join on m/z bins of ``width``, in which a query peak is in each
    bin its window touches and another peak in its one bin, then the exact condition."""
    q = query.withColumn("bin", F.explode(F.sequence(F.floor((F.col("q_mz") - tolerance) / width), F.floor((F.col("q_mz") + tolerance) / width))))
    return q.join(peaks.withColumn("bin", F.floor(F.col("mz") / width)), "bin").where(F.col("mz").between(F.col("q_mz") - tolerance, F.col("q_mz") + tolerance)).drop("bin")


def embedding_bins(peaks: DataFrame, method: str = "dreams") -> DataFrame:
    """spectrum_id, bin, value: the histogram without noise, its empty bins left out."""
    made = get_embedder(method)
    return peaks.groupBy("spectrum_id", mz_bin(F.col("mz")).alias("bin")).agg(F.sum(made.column(F.col("intensity"))).alias("value"))


def histogram_cosine(query_id: int, peaks: DataFrame, method: str = "dreams") -> DataFrame:
    """spectrum_id, score of every spectrum against one of them, by histograms without noise.  The
    query's bins are at most 1,024 rows and are broadcast."""
    bins = embedding_bins(peaks, method)
    q = embedding_bins(peaks.where(F.col("spectrum_id") == query_id), method).select("bin", F.col("value").alias("q"))
    norm = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    rows = bins.join(F.broadcast(q), "bin", "left").groupBy("spectrum_id").agg(F.sum(F.col("value") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    rows = rows.crossJoin(F.broadcast(norm))
    bottom = F.col("norm") * F.col("q_norm")
    return rows.select("spectrum_id", F.when(F.coalesce(bottom, F.lit(0.0)) == 0, 0.0).otherwise(F.col("dot") / bottom).alias("score"))

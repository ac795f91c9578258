"""Quality control: metrics of each spectrum, roll-ups, grades, the routing verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import DIAGNOSTIC_IONS, table
from ..functions.peaks import ion_mask
from .quantiles import exact_quantile
from .tables import materialized

HALF_WINDOW = 0.7  # Da on either side of a precursor
BLOCK = 70.0  # Da of precursor m/z that one window task gets


def diagnostic_masks(library: DataFrame) -> DataFrame:
    return library.select("id", ion_mask(F.col("peaks"), DIAGNOSTIC_IONS).alias("diag_mask"))


def co_isolated(spectra: DataFrame) -> DataFrame:
    """id, n_co_isolated: the other precursors of the same run within 0.7 Da.  A run is cut into blocks
    of m/z, each with a margin from its neighbours, so that a run of any size is many windows."""
    mz = F.col("precursor_mz")
    home = F.floor(mz / BLOCK)
    near = F.sequence(F.floor((mz - 2 * HALF_WINDOW) / BLOCK), F.floor((mz + 2 * HALF_WINDOW) / BLOCK))
    rows = spectra.select("id", "run_id", "precursor_mz", home.alias("home"), F.explode(near).alias("block"))
    around = f"count(*) OVER (PARTITION BY run_id, block ORDER BY precursor_mz RANGE BETWEEN {HALF_WINDOW}D PRECEDING AND {HALF_WINDOW}D FOLLOWING) - 1"
    return rows.withColumn("n", F.expr(around)).where("home = block").select("id", F.col("n").cast("int").alias("n_co_isolated"))


def metrics(library: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, snr, n_peaks, precursor_mz, diag_mask, is_chimeric, n_co_isolated of each spectrum, and the
    columns to ``keep``.

    snr is the largest intensity over the exact 10th percentile (null without peaks).
    """
    x = F.array_sort(F.transform("peaks", lambda p: p["intensity"]))
    place = (F.size(x) - 1) * F.lit(0.1)
    low = F.floor(place).cast("int")
    below, above = F.get(x, low), F.coalesce(F.get(x, low + 1), F.get(x, low))
    tenth = below + (above - below) * (place - low)
    own = library.select("id", *keep, "precursor_mz", F.size("peaks").alias("n_peaks"), F.when(F.size("peaks") > 0, F.array_max(x) / tenth).alias("snr"), ion_mask(F.col("peaks"), DIAGNOSTIC_IONS).alias("diag_mask"))
    joined = own.join(co_isolated(library.select("id", "run_id", "precursor_mz")), "id")
    return joined.select("id", "snr", "n_peaks", "precursor_mz", "diag_mask", (F.col("n_co_isolated") > 0).alias("is_chimeric"), "n_co_isolated", *keep)


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.count("*") * 100


def summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All roll-ups, as one row or one for each group ``by``.  All but the exact medians are from one
    aggregation; the medians are selected range by range (:mod:`.quantiles`), so no task holds the
    values of all spectra, or of a large group."""
    rows = materialized(rows.select(*by, "snr", "n_peaks", "diag_mask", "is_chimeric", "n_co_isolated"), "metrics")
    out = _roll_up(rows, by)
    for c, name in (("snr", "median_snr"), ("n_peaks", "median_peaks")):
        middle = exact_quantile(rows, c, by=by).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("quantile").alias(name))
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(middle, same, "left").drop(*[f"_{k}" for k in by])
    return out


def _roll_up(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    snr, n = F.col("snr"), F.col("n_peaks")
    bits = [F.count_if(F.col("diag_mask").bitwiseAND(1 << bit) > 0).alias(f"bit_{bit}") for bit, _, _ in DIAGNOSTIC_IONS]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_spectra"), F.avg(snr).alias("mean_snr"), _share(snr < 3).alias("pct_low_snr"), _share(snr > 100).alias("pct_high_snr"),
        F.avg(n).alias("mean_peaks"), F.stddev_pop(n).alias("std_peaks"), _share(n < 5).alias("pct_sparse"), _share(n > 100).alias("pct_dense"),
        F.count_if(F.col("is_chimeric")).alias("n_chimeric"), _share(F.col("is_chimeric")).alias("pct_chimeric"),
        F.avg(F.when(F.col("n_co_isolated") > 0, F.col("n_co_isolated"))).alias("mean_co_isolated"), *bits,
    )


def _ladder(rungs: list[tuple[Column, str]], last: str) -> Column:
    out = F.when(*rungs[0])
    for condition, grade in rungs[1:]:
        out = out.when(condition, grade)
    return out.otherwise(last)


def graded(one: DataFrame) -> DataFrame:
    """Adds the grades, the counts of prevalent ions and the routing scores to a summary row."""
    c = F.col
    share = lambda bit: c(f"bit_{bit}") / c("n_spectra")
    count = lambda bits, least, times: sum((F.when(share(b) * times > least, 1).otherwise(0) for b in bits), F.lit(0))
    out = one.withColumns(
        {
            "snr_grade": _ladder([(c("pct_low_snr") > 30, "POOR"), (c("pct_low_snr") > 10, "FAIR")], "GOOD"),
            "density_grade": _ladder([(c("pct_sparse") > 20, "SPARSE"), (c("pct_dense") > 20, "DENSE")], "NORMAL"),
            "chimericity_grade": _ladder([(c("pct_chimeric") > 25, "HIGH"), (c("pct_chimeric") > 10, "MODERATE")], "LOW"),
            "prevalent_ions": count([b for b, _, m in DIAGNOSTIC_IONS if m > 0], 10, 100),
            "richness": count([b for b, _, _ in DIAGNOSTIC_IONS], 0.1, 1),
        }
    )
    return route(out)


def route(one: DataFrame) -> DataFrame:
    """Adds score_classical, score_ml and recommendation."""
    points = [
        (F.col("pct_low_snr") > 20, (-1, 2), (2, 0)), (F.col("pct_chimeric") > 20, (-2, 3), None), (F.col("pct_chimeric").between(10, 20) & (F.col("pct_chimeric") > 10), (0, 1), None),
        (F.col("pct_chimeric") <= 10, (2, 0), None), (F.col("pct_sparse") > 20, (-1, 1), None), (F.col("richness") >= 4, (0, 1), (1, 0)),
    ]
    total = lambda k: sum((F.when(condition, yes[k]).otherwise(no[k] if no else 0) for condition, yes, no in points), F.lit(0))
    out = one.withColumns({"score_classical": total(0), "score_ml": total(1)})
    verdict = F.when(F.col("score_ml") > F.col("score_classical"), "ml").when(F.col("score_classical") > F.col("score_ml"), "classical").otherwise("hybrid")
    return out.withColumn("recommendation", verdict)


def prevalence(masks: DataFrame) -> DataFrame:
    """ion, bit, mz, n_spectra, pct for each ion of positive m/z."""
    ions = F.broadcast(table(masks.sparkSession, "ions"))
    counts = masks.agg(F.count("*").alias("total"), *[F.count_if(F.col("diag_mask").bitwiseAND(1 << b) > 0).alias(str(b)) for b, _, _ in DIAGNOSTIC_IONS])
    rows = counts.select("total", F.explode(F.create_map(*[x for b, _, _ in DIAGNOSTIC_IONS for x in (F.lit(b), F.col(str(b)))])).alias("bit", "n_spectra"))
    return rows.join(ions, "bit").where("mz > 0").select("ion", "bit", "mz", "n_spectra", (F.col("n_spectra") / F.col("total") * 100).alias("pct"))

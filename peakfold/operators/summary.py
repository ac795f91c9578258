"""What a scan holds: the first spectra, their strongest peaks, their base peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.peaks import above_noise, base_peak, strongest


def summarize_spectra(spectra: DataFrame, max_spectra: int = 5, noise_threshold: float = 0.0, top: int = 10) -> DataFrame:
    """The first spectra by index: index, ms_level, rt, status, n_peaks, top_peaks, base_mz, base_intensity.

    ``spectra``: index, ms_level, rt, peaks (null or empty: ``no peak data``; none left above the
    threshold: ``all peaks below noise threshold``; else ``ok``).
    """
    if not 1 <= max_spectra <= 50:
        raise ValueError("max_spectra must be 1 to 50")
    if noise_threshold < 0:
        raise ValueError("noise_threshold must not be negative")
    rows = spectra.orderBy("index").limit(max_spectra)
    left = above_noise(F.col("peaks"), noise_threshold)
    status = F.when(F.coalesce(F.size("peaks"), F.lit(0)) < 1, "no peak data").when(F.size(left) < 1, "all peaks below noise threshold").otherwise("ok")
    rows = rows.withColumns({"left": left, "status": status})
    base = base_peak(F.col("left"))
    return rows.select(
        "index", "ms_level", "rt", "status", F.greatest(F.coalesce(F.size("left"), F.lit(0)), F.lit(0)).alias("n_peaks"),
        strongest(F.col("left"), top).alias("top_peaks"), base["mz"].alias("base_mz"), base["intensity"].alias("base_intensity"),
    )

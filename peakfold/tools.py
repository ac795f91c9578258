"""The tools by name, each a call that returns a short text; the DataFrame operators do the work."""

from __future__ import annotations

import os
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import chem
from .functions.peaks import TOLERANCE
from .operators import qc, render, search, similarity, summary
from .operators.jobs import COMPLETED, FAILED, Jobs
from .sources import files

_LIST = "array<struct<mz:double,intensity:double>>"


def ping(spark: SparkSession, extra: str = "rdkit") -> DataFrame:
    """status, message, and whether the optional chemistry module can be imported."""
    return spark.createDataFrame([("ok", f"peakfold {__version__} on Spark {spark.version}", find_spec(extra) is not None)], "status string, message string, chem_extra boolean")


def load_mzml_summary(spark: SparkSession, file_path: str, max_spectra: int = 5, noise_threshold: float = 0.0) -> str:
    """The first spectra of an .mzML or .mgf file; what is wrong with a path is returned as text."""
    problem = files.check_path(file_path)
    if problem:
        return problem
    try:
        return render.spectra_report(summary.summarize_spectra(files.read_spectra(spark, file_path), max_spectra, noise_threshold), os.path.basename(file_path), max_spectra)
    except ValueError:
        raise
    except Exception as e:
        return f"ERROR: Failed to parse '{file_path}': {e}"


def predict_adduct_offset(spark: SparkSession, adduct_string: str) -> str:
    chem.require_length(adduct_string, 3, "adduct_string")
    return render.adduct_report(chem.lookup_adducts(spark.createDataFrame([(adduct_string,)], "adduct_string string")).first())


def annotate_isotopes(spark: SparkSession, identifier: str, is_smiles: bool = False) -> str:
    chem.require_length(identifier, 1, "identifier")
    rows = spark.createDataFrame([(identifier,)], "smiles string")
    rows = chem.smiles_formula(rows, read=True) if is_smiles else rows.withColumn("formula", F.col("smiles"))
    return render.isotope_report(chem.isotope_patterns(rows).collect())


def validate_precursor(theoretical_mass: float, experimental_mass: float) -> str:
    return render.ppm_report(theoretical_mass, experimental_mass)


def compute_cosine(spark: SparkSession, query_peaks, reference_peaks, ms2_tolerance: float = TOLERANCE, scoring_method: str = "classical") -> str:
    pair = [tuple([(float(m), float(x)) for m, x in peaks] for peaks in (query_peaks, reference_peaks))]
    rows = spark.createDataFrame(pair, f"query {_LIST}, reference {_LIST}")
    return render.cosine_report(similarity.compare(rows, scoring_method, ms2_tolerance).first())


def generate_qc_summary(library: DataFrame) -> str:
    """``library``: id, run_id, precursor_mz, peaks."""
    return render.qc_report(qc.graded(qc.summary(qc.metrics(library))).first())


def search_library(jobs: Jobs, query: DataFrame, library: DataFrame, scoring_method: str = "classical") -> str:
    """Dispatch a search and return its job id at once."""
    similarity.check_method(scoring_method)
    return jobs.dispatch(lambda: search.search(query, library, scoring_method).withColumns({"library_size": F.lit(library.count()), "scoring": F.lit(scoring_method)}), f"search, {scoring_method}")


def check_search_status(jobs: Jobs, job_id: str) -> str:
    """The hits of a finished search, the traceback of a failed one, or where it stands."""
    found = jobs.status(job_id)
    if found["state"] == COMPLETED:
        hits = jobs.result(job_id)
        first = hits.first()
        return render.hits_report(hits, first["library_size"] if first else 0, method=first["scoring"] if first else None)
    return f"{found['message']}\n\n{found['error']}" if found["state"] == FAILED else found["message"]

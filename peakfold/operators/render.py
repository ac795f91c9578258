"""Reports as text, from results that are small already (a top-k, one row)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dims import DIAGNOSTIC_IONS
from ..functions.embed import DIM
from ..functions.peaks import TOLERANCE


def intensity(x: float) -> str:
    return f"{x:.2e}" if abs(x) >= 1e6 else f"{x:.2f}"


def spectra_report(summary: DataFrame, name: str, max_spectra: int) -> str:
    """Of the rows that ``summarize_spectra`` limits to 50 at most."""
    rows = summary.orderBy("index").collect()
    out = [f"File: {name}", "-" * 50]
    for r in rows:
        rt = "N/A" if r["rt"] is None else f"{r['rt']:.2f}"
        out.append(f"Spectrum #{'?' if r['index'] is None else r['index']} | MS{'?' if r['ms_level'] is None else r['ms_level']} | RT {rt} min")
        if r["status"] != "ok":
            out.append(f"  ({r['status']})")
            continue
        out.append(f"  {r['n_peaks']} peaks; base peak {r['base_mz']:.4f} ({intensity(r['base_intensity'])})")
        out += [f"    {p['mz']:.4f}  {intensity(p['intensity'])}" for p in r["top_peaks"]]
    out += ["-" * 50, f"{len(rows)} spectra shown."]
    if len(rows) >= max_spectra:
        out.append("There may be more; raise max_spectra to see them.")
    return "\n".join(out)


def adduct_report(row) -> str:
    if row["rejected"]:
        return f"REJECTED: '{row['adduct_string']}' is not a known adduct."
    return f"Adduct: {row['canonical']}\nPolarity: {row['polarity']}\nCharge: {row['charge']:+d}\nShift: {row['shift']:+.6f} Da\nm/z = {row['offset']}"


def isotope_report(rows: list) -> str:
    """Of the rows of one formula."""
    if rows[0]["error"]:
        return f"ERROR: {rows[0]['error']}"
    by = {r["label"]: r for r in rows}
    out = [f"Isotope pattern of {rows[0]['formula']}", "", "| Isotopologue | Mass (Da) | Abundance |", "|---|---|---|"]
    return "\n".join(out + [f"| {k} | {by[k]['mass']:.4f} | {by[k]['abundance']:.4f} |" for k in ("M", "M+1", "M+2")])


def ppm_report(theoretical: float, experimental: float, limit: float = 5.0) -> str:
    if not (theoretical > 0 and experimental > 0):
        raise ValueError("masses must be positive")
    ppm = abs(theoretical - experimental) / theoretical * 1e6
    return f"VALIDATION {'PASSED' if ppm <= limit else 'REJECTED'}\nMass error: {ppm:.2f} ppm (limit {limit:.1f})"


def cosine_report(row, top: int = 15) -> str:
    if row["error"]:
        return f"ERROR: {row['error']}"
    out = [f"Cosine similarity: {row['score']:.4f}"]
    if row["n_matched"] is None:
        return "\n".join([*out, f"{row['n_query']} and {row['n_ref']} peaks compared by embeddings"])
    out.append(f"Matched {row['n_matched']} / {row['n_query']} query peaks ({row['pct_matched']:.1f} %), {row['n_matched']} / {row['n_ref']} of the reference ({row['pct_ref_used']:.1f} %)")
    lost = sorted(row["unmatched"], key=lambda p: -p["intensity"])
    out += [f"  {p['mz']:.4f}  {intensity(p['intensity'])}" for p in lost[:top]]
    return "\n".join(out + [f"  ... and {len(lost) - top} more"] * (len(lost) > top))


def scoring(method: str) -> str:
    """What a search compared, in words."""
    return f"peaks, matched greedily within {TOLERANCE} Da" if method == "classical" else f"embeddings of the {method} kind, {DIM} numbers each"


def hits_report(hits: DataFrame, library_size: int, small: int = 2_000, method: str | None = None) -> str:
    """Of the rows that ``search`` limits to its top."""
    rows = hits.orderBy("rank").collect()
    out = [f"Library: {library_size:,} spectra"] + [f"Scored by {scoring(method)}"] * (method is not None)
    if library_size < small:
        out.append(f"WARNING: fewer than {small} spectra; judged by empirical p-values instead of q-values.")
    if not rows:
        return "\n".join([*out, "No hits passed the threshold."])
    name = "q_value" if rows[0]["mode"] == "fdr" else "p_value"
    out += [f"| Rank | Compound | Score | {name} | Precursor m/z | Formula |", "|---|---|---|---|---|---|"]
    return "\n".join(out + [f"| {r['rank']} | {r['compound_name']} | {r['score']:.4f} | {r[name]:.4f} | {r['precursor_mz']:.4f} | {r['formula']} |" for r in rows])


def qc_report(row) -> str:
    """Of the one row that ``graded`` makes."""
    n = row["n_spectra"]
    out = [
        f"Spectra: {n:,}", f"Signal to noise: {row['snr_grade']} (mean {row['mean_snr']:.1f}, median {row['median_snr']:.1f}, below 3: {row['pct_low_snr']:.1f} %, above 100: {row['pct_high_snr']:.1f} %)",
        f"Peaks: {row['density_grade']} (mean {row['mean_peaks']:.1f}, median {row['median_peaks']:.1f}, deviation {row['std_peaks']:.1f}, sparse {row['pct_sparse']:.1f} %, dense {row['pct_dense']:.1f} %)",
        f"Chimericity: {row['chimericity_grade']} ({row['n_chimeric']} spectra, {row['pct_chimeric']:.1f} %)",
    ]
    out += [f"  {name} ({mz:.4f}): {row[f'bit_{bit}']} spectra, {row[f'bit_{bit}'] / n * 100:.1f} %" for bit, name, mz in DIAGNOSTIC_IONS if mz > 0]
    bit, name, mz = DIAGNOSTIC_IONS[0]
    seen = row[f"bit_{bit}"]
    out.append(f"{name} ({mz:.3f} Da): in {seen} of {n} spectra, {seen / n * 100:.1f} %" if seen else f"{name} ({mz:.3f} Da): in no spectrum")
    if row["prevalent_ions"] >= 3:
        out.append("Several diagnostic ions are frequent: the sample may be rich in peptides.")
    out.append(f"Recommendation: {row['recommendation']} (classical {row['score_classical']:+d}, ml {row['score_ml']:+d})")
    return "\n".join(out + [f"  because {reason}" for reason in reasons(row)])


def reasons(row) -> list[str]:
    """What speaks for the verdict, from the roll-ups that decide it."""
    noisy, mixed, sparse = row["pct_low_snr"], row["pct_chimeric"], row["pct_sparse"]
    out = [f"{noisy:.1f} % of spectra are noisy, which blurs peak matching" if noisy > 20 else f"few spectra are noisy ({noisy:.1f} %)"]
    out.append(f"{mixed:.1f} % of spectra mix precursors, which a learned model separates better" if mixed > 10 else f"few spectra mix precursors ({mixed:.1f} %), so peaks match cleanly")
    if sparse > 20:
        out.append(f"{sparse:.1f} % of spectra have too few peaks to match")
    out.append(f"{row['richness']} diagnostic ions are frequent" + (", more than plain matching makes use of" if row["richness"] >= 4 else ""))
    if row["recommendation"] == "hybrid":
        out.append("both sides weigh the same: match the clean spectra by peaks, the noisy and mixed ones by a model, and join the results")
    return out

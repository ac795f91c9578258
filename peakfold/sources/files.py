"""Spectra files: MGF and mzML, both read in parallel and written."""

from __future__ import annotations

import base64
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.peaks import PEAK
from ..operators.tables import shared_dir

VENDOR = (".raw", ".d")
READ = (".mzml", ".mgf")
SPECTRUM = f"index int, ms_level int, rt double, precursor_mz double, peaks array<{PEAK}>"


def check_path(path: str) -> str | None:
    """Null, or why a path cannot be read: a vendor's format, an unknown ending, or no such file (for
    local paths; others are left to Spark)."""
    ext = os.path.splitext(path)[1].lower()
    if ext in VENDOR:
        return f"ERROR: Unsupported vendor format '{ext}'. Convert the file to .mzML first."
    if ext not in READ:
        return f"WARNING: Unrecognised file extension '{ext}'. Only .mzML and .mgf are supported."
    if "://" not in path and not os.path.exists(path):
        return f"ERROR: File not found: '{path}'"
    return None


def read_spectra(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """index, ms_level, rt (minutes), precursor_mz, peaks of an .mzML or .mgf file or folder; with
    ``errors`` also file and error, null or what is wrong with the record."""
    problem = check_path(path)
    if problem:
        raise ValueError(problem)
    return (read_mgf if path.lower().endswith(".mgf") else read_mzml)(spark, path, errors)


def scan_report(spectra: DataFrame) -> DataFrame:
    """file, n_spectra, n_errors, first_error of every file that spectra were read from with ``errors``.
    A broken file has its error here, and the others are read all the same; empty files have no row."""
    bad = F.col("error").isNotNull()
    return spectra.groupBy("file").agg(F.count_if(~bad).alias("n_spectra"), F.count_if(bad).alias("n_errors"), F.min("error").alias("first_error"))


_PEAK_LINE = r"^[ \t]*([0-9.eE+-]+)[ \t]+([0-9.eE+-]+)[^\n]*$"


def mgf_rows(text: Column) -> list[Column]:
    """The columns of one record of an MGF file."""
    field = lambda name: F.regexp_extract(text, rf"(?m)^{name}=\s*([^\s]+)", 1).try_cast("double")
    line = f"(?m){_PEAK_LINE}"
    mz, x = (F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(k)), lambda v: v.try_cast("double")) for k in (1, 2))
    pairs = F.zip_with(mz, x, lambda a, b: F.struct(a.alias("mz"), b.alias("intensity")))
    return [field("SCANS").cast("int").alias("index"), F.coalesce(field("MSLEVEL").cast("int"), F.lit(2)).alias("ms_level"), (field("RTINSECONDS") / 60).alias("rt"), field("PEPMASS").alias("precursor_mz"), pairs.alias("peaks")]


def read_mgf(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """One record for each BEGIN IONS .. END IONS, split by Spark's own reader; JVM expressions only.  A
    record with lines that are neither peaks nor fields has its other peaks, and an error that counts them."""
    text = spark.read.option("lineSep", "END IONS").text(path)
    text = (text.select("value", F.col("_metadata.file_path").alias("file")) if errors else text).where(F.col("value").contains("BEGIN IONS"))
    whole = F.regexp_replace("value", "\r", "")
    rows = mgf_rows(whole)
    if not errors:
        return text.select(*rows)
    body = F.filter(F.split(F.regexp_replace(whole, r"(?s)^.*BEGIN IONS", ""), "\n"), lambda x: F.trim(x) != "")
    strange = F.size(F.filter(body, lambda x: ~x.rlike(rf"^[A-Za-z0-9_ ]+=|^[#;!/]|{_PEAK_LINE}")))
    return text.select(*rows, "file", F.when(strange > 0, F.concat(strange.cast("string"), F.lit(" lines are neither peaks nor fields"))).alias("error"))


_PARAM = "struct<_accession:string,_value:string>"
_REFS = "referenceableParamGroupRef array<struct<_ref:string>>"
_NESTED_REFS = _REFS.replace(" array", ":array")
_MZML = (
    f"_index int, cvParam array<{_PARAM}>, {_REFS}, scanList struct<scan:array<struct<cvParam:array<struct<_accession:string,_value:string,_unitAccession:string>>>>>, "
    f"precursorList struct<precursor:array<struct<selectedIonList:struct<selectedIon:array<struct<cvParam:array<{_PARAM}>,{_NESTED_REFS}>>>>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:array<{_PARAM}>,{_NESTED_REFS},binary:string>>>, _corrupt_record string"
)
#: Spectra whose arrays are decoded at once.
ROWS = 500
#: Files whose parameter groups are broadcast (some kB each); those of more files are joined by file.
MOST_FILES = 2_000
# Accessions of the mass spectrometry vocabulary.
MS_LEVEL, SCAN_START, SELECTED_MZ, MZ_ARRAY, INTENSITY_ARRAY, FLOAT_32, FLOAT_64, ZLIB = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000514", "MS:1000515", "MS:1000521", "MS:1000523", "MS:1000574"
SECONDS = "UO:0000010"


def _decode(data: str | None, kinds) -> np.ndarray | None:
    if data is None:
        return None
    raw = base64.b64decode(data)
    if ZLIB in kinds:
        raw = zlib.decompress(raw)
    return np.frombuffer(raw, "<f4" if FLOAT_32 in kinds else "<f8").astype(float)


def _columns(parts) -> tuple[np.ndarray, np.ndarray] | None:
    """m/z and intensities of one spectrum's encoded arrays; null where one is missing or broken."""
    found = {}
    try:
        for part in parts if parts is not None else []:
            kinds = {p["_accession"] for p in (part["cvParam"] if part["cvParam"] is not None else [])}
            for name in kinds & {MZ_ARRAY, INTENSITY_ARRAY}:
                found[name] = _decode(part["binary"], kinds)
        mz, x = found[MZ_ARRAY], found[INTENSITY_ARRAY]
        return (mz, x) if len(mz) == len(x) else None
    except (KeyError, ValueError, TypeError, zlib.error):
        return None


def _lists(parts: list) -> pa.Array:
    made = [_columns(p) for p in parts]
    good = [m for m in made if m is not None]
    ends = np.cumsum([0, *(0 if m is None else len(m[0]) for m in made)])
    mz, x = (pa.array(np.concatenate([np.zeros(0), *(m[k] for m in good)]), from_pandas=True) for k in (0, 1))  # NaN stands for a missing number
    peaks = pa.StructArray.from_arrays([mz, x], ["mz", "intensity"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), peaks, mask=pa.array([m is None for m in made], pa.bool_()))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])))
def _decoded(arrays: pa.Array) -> pa.Array:
    """Peaks from the encoded arrays, few spectra at a time; no object is made for a peak."""
    return pa.concat_arrays([_lists(arrays.slice(at, ROWS).to_pylist()) for at in range(0, max(len(arrays), 1), ROWS)])


def _param_groups(spark: SparkSession, path: str) -> DataFrame:
    """file and groups, a map from a group's id to its parameters, of every file that has any."""
    rows = spark.read.format("xml").option("rowTag", "referenceableParamGroup").schema(f"_id string, cvParam array<{_PARAM}>").load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "_id", F.coalesce("cvParam", F.array().cast(f"array<{_PARAM}>")).alias("params")).where("_id is not null")
    one = rows.groupBy("file", "_id").agg(F.first("params").alias("params"))
    return one.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("_id", "params"))).alias("groups"))


def read_mzml(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """Spark's XML reader splits the file at <spectrum>; only the binary arrays are decoded in Python,
    a batch at a time.  Parameters that a spectrum takes from a group of its file count as its own; the
    groups are read in a pass before.  A spectrum whose arrays are broken has null peaks.

    With ``errors``, file and error are added, and what is no XML is a row with an error and nothing
    else; without, it has no row.
    """
    rows = spark.read.format("xml").option("rowTag", "spectrum").option("columnNameOfCorruptRecord", "_corrupt_record").schema(_MZML).load(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
    groups = _param_groups(spark, path)
    n = groups.limit(MOST_FILES + 1).count()
    if n:
        rows = rows.join(F.broadcast(groups) if n <= MOST_FILES else groups, "file", "left")
    else:
        rows = rows.withColumn("groups", F.lit(None).cast(f"map<string,array<{_PARAM}>>"))
    none = F.array().cast(f"array<{_PARAM}>")

    def params(own: Column, refs: Column) -> Column:
        taken = F.transform(F.coalesce(refs, F.array().cast("array<struct<_ref:string>>")), lambda r: F.coalesce(F.try_element_at("groups", r["_ref"]), none))
        return F.concat(F.coalesce(own, none), F.flatten(taken))

    first = lambda found, key: F.get(F.filter(found, lambda p: p["_accession"] == key), F.lit(0))
    scan = first(F.get("scanList.scan", F.lit(0))["cvParam"], SCAN_START)
    minutes = scan["_value"].try_cast("double") / F.when(scan["_unitAccession"] == SECONDS, 60.0).otherwise(1.0)
    ion = F.get(F.get("precursorList.precursor", F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0))
    arrays = F.transform("binaryDataArrayList.binaryDataArray", lambda a: F.struct(params(a["cvParam"], a["referenceableParamGroupRef"]).alias("cvParam"), a["binary"].alias("binary")))
    # what is no XML has no index either; Spark's reader wants a second column beside that of broken records
    broken = F.col("_corrupt_record").isNotNull() & F.col("_index").isNull()
    out = rows.select(
        F.col("_index").alias("index"), first(params(F.col("cvParam"), F.col("referenceableParamGroupRef")), MS_LEVEL)["_value"].try_cast("int").alias("ms_level"), minutes.alias("rt"),
        first(params(ion["cvParam"], ion["referenceableParamGroupRef"]), SELECTED_MZ)["_value"].try_cast("double").alias("precursor_mz"), _decoded(arrays).alias("peaks"), "file", broken.alias("broken"),
    )
    if not errors:
        return out.where("not broken").drop("file", "broken")
    error = F.when(F.col("broken"), "not well-formed XML").when(F.col("peaks").isNull(), "the m/z or intensity array is missing or broken")
    return out.withColumn("error", error).drop("broken")


def write_mgf(spectra: DataFrame, path: str) -> None:
    """``spectra``: index, rt, precursor_mz, peaks."""
    lines = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    head = F.concat(F.lit("BEGIN IONS\nSCANS="), F.col("index").cast("string"), F.lit("\nRTINSECONDS="), (F.coalesce("rt", F.lit(0.0)) * 60).cast("string"), F.lit("\nPEPMASS="), F.col("precursor_mz").cast("string"), F.lit("\n"))
    spectra.select(F.concat(head, lines, F.lit("\nEND IONS")).alias("value")).write.text(path)


def _encoded(values: Column, kind: str, groups: bool) -> Column:
    says = f'<referenceableParamGroupRef ref="{kind}"/>' if groups else _kinds(kind)
    return F.concat(F.lit(f"<binaryDataArray>{says}<binary>"), _packed(values), F.lit("</binary></binaryDataArray>"))


def _kinds(kind: str) -> str:
    return "".join(f'<cvParam accession="{a}" value=""/>' for a in (FLOAT_64, ZLIB, kind))


@F.arrow_udf(T.StringType())
def _packed(values: pa.Array) -> pa.Array:
    flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False), np.cumsum([0, *(n or 0 for n in pc.list_value_length(values).to_pylist())]).tolist()
    return pa.array([base64.b64encode(zlib.compress(flat[a:b].tobytes())).decode() for a, b in zip(ends, ends[1:])], pa.string())


def write_mzml(spectra: DataFrame, path: str, groups: bool = False) -> None:
    """One document for each partition; ``spectra``: index, ms_level, rt, precursor_mz, peaks.  With
    ``groups`` what all spectra have in common is written once, as parameter groups."""
    p = lambda key, value, more="": F.concat(F.lit(f'<cvParam accession="{key}"{more} value="'), value.cast("string"), F.lit('"/>'))
    arrays = [_encoded(F.col(f"peaks.{f}"), kind, groups) for f, kind in (("mz", MZ_ARRAY), ("intensity", INTENSITY_ARRAY))]
    text = F.concat(
        F.lit('<spectrum index="'), F.col("index").cast("string"), F.lit('">'), p(MS_LEVEL, F.col("ms_level")), F.lit("<scanList><scan>"), p(SCAN_START, F.coalesce("rt", F.lit(0.0)), ' unitAccession="UO:0000031"'),
        F.lit("</scan></scanList><precursorList><precursor><selectedIonList><selectedIon>"), p(SELECTED_MZ, F.col("precursor_mz")), F.lit("</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList>"),
        *arrays, F.lit("</binaryDataArrayList></spectrum>"),
    )
    spectra.select(text.alias("value")).mapInArrow(_document(groups), "value string").write.text(path)


def _document(groups: bool):
    line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], ["value"])
    shared = "".join(f'<referenceableParamGroup id="{k}">{_kinds(k)}</referenceableParamGroup>' for k in (MZ_ARRAY, INTENSITY_ARRAY))
    head = f"<referenceableParamGroupList>{shared}</referenceableParamGroupList>" if groups else ""

    def document(batches):
        yield line(f"<mzML>{head}<run><spectrumList>")
        yield from batches
        yield line("</spectrumList></run></mzML>")

    return document


def roundtrip(library: DataFrame, kind: str) -> DataFrame:
    """Write a library to the session's shared folder in a format (mgf, mzml, or mzml-groups, which has
    parameter groups) and read it back."""
    spark = library.sparkSession
    path = f"{shared_dir(spark)}/spectra-{uuid.uuid4().hex}.{kind.split('-')[0]}"
    rows = library.select(F.col("id").cast("int").alias("index"), F.lit(2).alias("ms_level"), F.lit(0.0).alias("rt"), "precursor_mz", "peaks")
    if kind == "mgf":
        write_mgf(rows, path)
        return read_mgf(spark, path)
    write_mzml(rows, path, groups=kind == "mzml-groups")
    return read_mzml(spark, path)

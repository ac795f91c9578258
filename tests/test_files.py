"""Spectra files: parameter groups, broken records and files."""

import base64
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from peakfold.sources import files

MZ, X = [100.5, 200.25], [1.0, 9.0]


def packed(values, kind="<f8", squeeze=False):
    raw = np.asarray(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if squeeze else raw).decode()


def param(*accessions, value=""):
    return "".join(f'<cvParam accession="{a}" value="{value}"/>' for a in accessions)


def array(kinds, values, **how):
    return f"<binaryDataArray>{kinds}<binary>{packed(values, **how)}</binary></binaryDataArray>"


def spectrum(index, arrays, head=""):
    return f'<spectrum index="{index}">{head}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'


def document(body, groups=""):
    return f'<?xml version="1.0"?><mzML>{groups}<run><spectrumList>{body}</spectrumList></run></mzML>'


def ref(name):
    return f'<referenceableParamGroupRef ref="{name}"/>'


def group(name, inside):
    return f'<referenceableParamGroup id="{name}">{inside}</referenceableParamGroup>'


OWN = array(param(files.FLOAT_64, files.MZ_ARRAY), MZ) + array(param(files.FLOAT_64, files.INTENSITY_ARRAY), X)


@pytest.fixture()
def folder(tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    shared = array(ref("m"), MZ, squeeze=True) + array(ref("x"), X, kind="<f4")
    ion = f"<precursorList><precursor><selectedIonList><selectedIon>{ref('ion')}</selectedIon></selectedIonList></precursor></precursorList>"
    groups = f"<referenceableParamGroupList>{group('m', param(files.FLOAT_64, files.ZLIB, files.MZ_ARRAY))}{group('x', param(files.FLOAT_32, files.INTENSITY_ARRAY))}"
    groups += f"{group('two', param(files.MS_LEVEL, value=2))}{group('ion', param(files.SELECTED_MZ, value=321.5))}{group('none', '')}</referenceableParamGroupList>"
    put("a_groups.mzML", document(spectrum(0, shared, ref("two") + ion) + spectrum(1, OWN, param(files.MS_LEVEL, value=1)), groups))
    # the same ids with another meaning in another file, a group that is not there and one without parameters
    put("b_other.mzML", document(spectrum(0, array(ref("x"), MZ) + array(ref("m"), X)) + spectrum(1, array(ref("nowhere") + ref("none"), MZ)), f"{group('x', param(files.FLOAT_64, files.MZ_ARRAY))}{group('m', param(files.FLOAT_64, files.INTENSITY_ARRAY))}{group('none', '')}"))
    put("c_cut.mzML", document(spectrum(0, OWN))[: -len("</spectrumList></run></mzML>")] + '<spectrum index="1"><cvPar')
    put("d_junk.mzML", "no spectra here")
    put("e_arrays.mzML", document(spectrum(0, OWN) + spectrum(1, array(param(files.FLOAT_64, files.MZ_ARRAY), MZ)) + spectrum(2, "<binaryDataArray>" + param(files.MZ_ARRAY) + "<binary>%%%</binary></binaryDataArray>")))
    return tmp_path


def test_parameter_groups(spark, folder, monkeypatch):
    for most in (files.MOST_FILES, 1):  # broadcast and joined
        monkeypatch.setattr(files, "MOST_FILES", most)
        got = {(r.file.rsplit("/", 1)[1][0], r["index"]): r for r in files.read_mzml(spark, str(folder), errors=True).collect() if r["index"] is not None}
        peaks = {k: None if r.peaks is None else [tuple(p) for p in r.peaks] for k, r in got.items()}
        both = list(zip(MZ, X))
        assert peaks["a", 0] == peaks["a", 1] == peaks["b", 0] == both and peaks["b", 1] is None
        assert (got["a", 0].ms_level, got["a", 0].precursor_mz) == (2, 321.5) and (got["a", 1].ms_level, got["a", 1].precursor_mz) == (1, None)


def test_one_file_without_groups(spark, tmp_path):
    (tmp_path / "x.mzML").write_text(document(spectrum(0, OWN)))
    assert [tuple(p) for p in files.read_spectra(spark, str(tmp_path / "x.mzML")).first().peaks] == list(zip(MZ, X))


def test_a_folder_with_broken_files(spark, folder):
    rows = files.read_mzml(spark, str(folder), errors=True)
    got = {r.file.rsplit("/", 1)[1][0]: tuple(r)[1:] for r in files.scan_report(rows).collect()}
    arrays, xml = "the m/z or intensity array is missing or broken", "not well-formed XML"
    assert got == {"a": (2, 0, None), "b": (1, 1, arrays), "c": (1, 1, xml), "d": (0, 1, xml), "e": (1, 2, arrays)}
    assert files.read_mzml(spark, str(folder)).count() == 8  # what is no XML has no row


def test_mgf_records_with_strange_lines(spark, tmp_path):
    (tmp_path / "x.mgf").write_text("# a note\nBEGIN IONS\nTITLE=a b\nSCANS=1\nPEPMASS=500.5 3\n100.0 1.0\n200.0\t2.0 1+\nEND IONS\n\nBEGIN IONS\nSCANS=2\n100.0 1.0\noops\n300\nEND IONS\nBEGIN IONS\nSCANS=3\n7.5 1\n9")
    got = {r["index"]: r for r in files.read_spectra(spark, str(tmp_path / "x.mgf"), errors=True).collect()}
    assert {k: (len(r.peaks), r.error) for k, r in got.items()} == {1: (2, None), 2: (1, "2 lines are neither peaks nor fields"), 3: (1, "1 lines are neither peaks nor fields")}
    assert tuple(files.scan_report(files.read_mgf(spark, str(tmp_path / "x.mgf"), errors=True)).first())[1:] == (1, 2, "1 lines are neither peaks nor fields")


def test_decoding_makes_no_object_for_a_peak():
    n = 20_000
    packed = [base64.b64encode(np.arange(n, dtype="<f8").tobytes()).decode() for _ in range(2)]
    kinds = [[{"_accession": files.FLOAT_64, "_value": ""}, {"_accession": a, "_value": ""}] for a in (files.MZ_ARRAY, files.INTENSITY_ARRAY)]
    rows = pa.array([[{"cvParam": k, "binary": b} for k, b in zip(kinds, packed)]] * 40)
    tracemalloc.start()
    out = files._decoded.func(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 40 and out[39][n - 1].as_py() == {"mz": n - 1.0, "intensity": n - 1.0}
    assert peak < 100 * 40 * n


def test_missing_numbers_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS", 2)
    rows = [(1, 2, 0.0, 5.0, [(1.0, None), (None, 2.0), (3.0, 4.0)]), *((i, 2, 0.0, 5.0, [(float(i), k + 1.0) for k in range(i % 4)]) for i in range(2, 9))]
    files.write_mzml(spark.createDataFrame(rows, files.SPECTRUM).coalesce(1), str(tmp_path / "a.mzml"))
    got = files.read_mzml(spark, str(tmp_path / "a.mzml")).orderBy("index").collect()
    assert [[tuple(p) for p in r["peaks"]] for r in got] == [r[4] for r in rows]

import gzip
import io

import numpy as np
import pytest
from test_files import mzml, spectrum

from lumentrace.sources import files
from lumentrace.sources import mzml as source


def indexed(content: bytes) -> bytes:
    parts = content.split(b"<spectrum>")
    return parts[0] + b"".join(b'<spectrum index="%d" id="s%d">' % (i, i) + p for i, p in enumerate(parts[1:]))


def many(n: int) -> bytes:
    rng = np.random.default_rng(3)
    return indexed(mzml(*[spectrum(1 + (i % 3 > 0), 100 - i, np.sort(rng.uniform(300, 900, i % 7)), rng.uniform(1, 9, i % 7), window=(500, 2) if i % 3 else None) for i in range(n)]))


def rows(frame):
    return sorted((r.run, r.scan, r.ms_level, r.rt, [tuple(p) for p in r.peaks]) for r in frame.collect())


def test_any_cut_reads_each_spectrum_once():
    content = many(9)
    whole = list(source.elements(io.BytesIO(content).read, 0, float("inf")))
    assert len(whole) == 9
    for step in (1, 37, 500, 4001):
        found = []
        for begin in range(0, len(content), step):
            stream = io.BytesIO(content)
            stream.seek(begin)
            found += source.elements(lambda n, s=stream: s.read(97), begin, begin + step)
        assert found == whole


def test_ranges_equal_one_task(spark, tmp_path):
    content = many(60)
    (tmp_path / "a.mzML").write_bytes(content)
    (tmp_path / "b.mzML.gz").write_bytes(gzip.compress(content))
    (tmp_path / "notes.txt").write_text("no spectra")
    one = files.read_mzml(spark, str(tmp_path), split_bytes=0)
    cut = files.read_mzml(spark, str(tmp_path), split_bytes=5000)
    assert one.rdd.getNumPartitions() == 2
    assert cut.rdd.getNumPartitions() > 5
    assert rows(one) == rows(cut) and [r[:2] for r in rows(cut)] == [(run, i) for run in "ab" for i in range(60)]
    first = files.read_mzml(spark, f"file://{tmp_path}/a.mzML", level=1, split_bytes=5000)
    assert rows(first) == [r for r in rows(one) if r[0] == "a" and r[2] == 1]


@pytest.mark.parametrize("cut", ["between spectra", "inside one", "footer"])
@pytest.mark.parametrize("split", [0, 3000])
def test_files_that_are_cut_off_fail(spark, tmp_path, cut, split):
    content = many(30)
    end = {"between spectra": content.rindex(b"<spectrum "), "inside one": content.rindex(b"<binary>") + 9, "footer": content.rindex(b"</mzML>")}[cut]
    (tmp_path / "a.mzML").write_bytes(content[:end])
    with pytest.raises(Exception, match="cut off"):
        files.read_mzml(spark, str(tmp_path), split_bytes=split).collect()
    (tmp_path / "a.mzML").unlink()
    (tmp_path / "a.mzML.gz").write_bytes(gzip.compress(content)[:-9])
    with pytest.raises(Exception, match="ended before"):
        files.read_mzml(spark, str(tmp_path), split_bytes=split).collect()


def test_no_index_needs_one_range(spark, tmp_path):
    content = many(30).replace(b" index=", b" place=")
    (tmp_path / "a.mzML").write_bytes(content)
    assert [r[1] for r in rows(files.read_mzml(spark, str(tmp_path)))] == list(range(30))
    with pytest.raises(Exception, match="has no index"):
        files.read_mzml(spark, str(tmp_path), split_bytes=3000).collect()


def test_empty_folder_and_missing_file(spark, tmp_path):
    assert files.read_mzml(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception):
        files.read_mzml(spark, str(tmp_path / "none.mzML")).collect()


def test_params_by_reference_and_other_encodings(spark, tmp_path):
    head = '<referenceableParamGroupList><referenceableParamGroup id="g"><cvParam accession="MS:1000511" value="2"/></referenceableParamGroup></referenceableParamGroupList>'
    body = many(40).decode().replace('<cvParam accession="MS:1000511" value="2"/>', '<referenceableParamGroupRef ref="g"/>').replace("<run>", f'<note name="\u00e4"/>{head}<run>')
    (tmp_path / "a.mzML").write_bytes(body.replace("<?xml version=\"1.0\"?>", '<?xml version="1.0" encoding="ISO-8859-1"?>').encode("latin-1"))
    assert [r[2] for r in rows(files.read_mzml(spark, str(tmp_path), split_bytes=4000))] == [1 + (i % 3 > 0) for i in range(40)]


def test_by_time(spark, tmp_path):
    (tmp_path / "a.mzML").write_bytes(many(40))
    found = sorted((r.scan, r.rt) for r in files.by_time(files.read_mzml(spark, str(tmp_path), split_bytes=4000)).collect())
    kept = sorted((100 - i) / 60 for i in range(40) if i % 3 == 0 and i % 7)
    assert found == list(enumerate(kept))


def test_profile_tops():
    mz = np.array([1.0, 2.0, 3.5, 4.0, 5.0, 6.0])
    value = 50 - (mz - 3.2) ** 2
    at = files._picked(mz, value)
    assert at.tolist() == [2] and files._apexes(mz, value, at) == pytest.approx([3.2])
    flat = np.array([0.0, 4.0, 4.0, 0.0])
    assert files._apexes(mz[[0, 1, 3, 4]], flat, files._picked(mz[:4], flat)) == pytest.approx([3.0])


def test_voltage_in(spark):
    frame = spark.createDataFrame([("-50.0 V",), (" 0",), ("-0.0",), ("inf",), ("none",), ("",), (None,)], "t string")
    got = [r[0] for r in frame.select(files.voltage_in(frame.t)).collect()]
    assert got == [-50.0, 0.0, 0.0, None, None, None, None] and str(got[2]) == "0.0"

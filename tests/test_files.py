import base64
import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import tracking as tk
from lumentrace.sources import files
from lumentrace.streaming import tracks


def spectrum(level, seconds, mz, value, extra="", window=None, double=True, packed=True, profile=False):
    kind = "<f8" if double else "<f4"

    def array(values, accession):
        raw = np.array(values, kind).tobytes()
        raw = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="{accession}"/><cvParam accession="{"MS:1000523" if double else "MS:1000521"}"/>{"<cvParam accession=%sMS:1000574%s/>" % (chr(34), chr(34)) if packed else ""}<binary>{raw}</binary></binaryDataArray>'

    iso = f'<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="{window[0]}"/><cvParam accession="MS:1000828" value="{window[1]}"/><cvParam accession="MS:1000829" value="{window[1]}"/></isolationWindow></precursor></precursorList>' if window else ""
    shape = '<cvParam accession="MS:1000128"/>' if profile else ""
    return f'<spectrum>{shape}<cvParam accession="MS:1000511" value="{level}"/>{extra}<scanList><scan><cvParam accession="MS:1000016" value="{seconds}" unitAccession="UO:0000010"/></scan></scanList>{iso}<binaryDataArrayList>{array(mz, "MS:1000514")}{array(value, "MS:1000515")}</binaryDataArrayList></spectrum>'


def mzml(*spectra):
    return f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{"".join(spectra)}</spectrumList></run></mzML>'.encode()


def test_mzml(spark, tmp_path):
    voltage = '<cvParam accession="MS:1001581" value="-50.0"/>'
    content = mzml(
        spectrum(1, 60, [500.0, 400.0, 300.0], [1.0, 2.0, 0.0], voltage), spectrum(1, 66, [], []), spectrum(2, 69, [200.0], [5.0], window=(500, 2.5), double=False, packed=False),
        spectrum(2, 70, [200.0], [5.0]), spectrum(1, 72, [1.0, 2, 3, 4, 5], [0.0, 5, 9, 5, 0], profile=True),
    )
    (tmp_path / "a.mzML").write_bytes(content)
    (tmp_path / "b.mzML.gz").write_bytes(gzip.compress(content))
    found = files.read_mzml(spark, str(tmp_path))
    one = sorted(files.peaks(found).where("run = 'a'").collect(), key=lambda r: (r.scan, r.mz))
    assert [(r.channel, r.scan, round(r.rt, 3), r.mz, r.intensity) for r in one] == [(-50.0, 0, 1.0, 400.0, 2.0), (-50.0, 0, 1.0, 500.0, 1.0), (None, 4, 1.2, 3.0, 9.0)]
    two = files.peaks(found, 2).collect()
    assert {(r.run, r.channel, r.mz) for r in two} == {("a", "497.5000:502.5000", 200.0), ("b", "497.5000:502.5000", 200.0)}
    (tmp_path / "c.mzML.gz").write_bytes(gzip.compress(content)[:-20])
    with pytest.raises(Exception):
        files.read_mzml(spark, str(tmp_path / "c.mzML.gz")).collect()


def peaks(spark, scans):
    rows = [("r", -40.0, s, 0.1 * s, 500.0, float(max(1, 100 - abs(s - 5))), 0.0, s) for s in scans]
    frame = spark.createDataFrame(rows, "run string, channel double, scan int, rt double, mz double, intensity double, im double, t int")
    return frame.withColumn("time", F.timestamp_seconds(F.col("t") + 1000)).drop("t")


@pytest.mark.parametrize("format", ["parquet", "tsv"])
def test_hills_round_trip(spark, tmp_path, format):
    hills = tk.numbered(tk.track(peaks(spark, range(10))))
    files.write_hills(hills, str(tmp_path / "h"), format)
    back = files.read_hills(spark, str(tmp_path / "h"), format).select(*hills.columns)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in hills.collect()]


def test_features_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("r", 500.0, 2, 10.0, 1, [1.0, 2.0]), ("r", 600.0, 0, 99.0, 0, [1.0]), ("r", 700.0, 3, 30.0, 0, [3.0])], "run string, mz double, charge int, intensity_sum double, neutron_offset int, observed array<double>")
    files.write_features(rows, str(tmp_path / "f"), "tsv")
    back = files.read_features(spark, str(tmp_path / "f"), "tsv").collect()
    assert {r.charge: round(r.raw_mz, 6) for r in back} == {2: round(500 + 1.0033548378 / 2, 6), 3: 700.0}
    found = files.report(rows.where("charge > 0")).first()["report"]
    assert '"n_features":2' in found and '"charges":{"2":1,"3":1}' in found
    assert '"mz":{"median":600.0,"std":141.4' in found and '"intensity_sum":{"median":20.0,' in found


def test_identifications(spark, tmp_path):
    head = "peptide\tfilename\tcharge\tcalcmass\trt\tspectrum_q\tpeptide_q\trank\tlabel\n"
    (tmp_path / "s.tsv").write_text(head + "PEP\tx/run1.mzML.gz\t2\t500.5\t3.0\t0.001\t0.01\t1\t1\nDEC\trun1.raw\t2\t500.5\t3.0\t0.001\t0.01\t1\t-1\nLOW\trun1.d\t2\t500.5\t3.0\t0.001\t0.01\t2\t1\n")
    assert [(r.run, r.peptide, r.q) for r in files.read_identifications(spark, str(tmp_path / "s.tsv"), sage=True).collect()] == [("run1", "PEP", 0.01)]
    (tmp_path / "g.tsv").write_text("modified_peptide\trun\tcharge\tneutral_mass\trt_minutes\tid_qvalue\nPEP\tr\t0\t500.5\t3.0\t0.001\n")
    with pytest.raises(Exception, match="bad identification"):
        files.read_identifications(spark, str(tmp_path / "g.tsv")).collect()


def test_stream_equals_batch(spark, tmp_path):
    scans = [[0, 1, 2, 3], [4, 5, 6, 20, 21, 22], [5], [900]]
    schema = peaks(spark, [0]).schema
    got = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, part in enumerate(scans):
        peaks(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = tracks.track_stream(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        if k == 1:
            assert [(r.scan_start, r.scan_end) for r in got] == [(0, 6)]
    spans = sorted((r.scan_start, r.scan_end) for r in got)
    assert spans == [(0, 6), (20, 22)]
    batch = {(r.scan_start, r.scan_end, r.intensity_sum) for r in tk.track(peaks(spark, [s for p in scans[:2] for s in p])).collect()}
    assert {(r.scan_start, r.scan_end, r.intensity_sum) for r in got} == batch

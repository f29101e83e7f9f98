import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from morpholake.operators import quality, stacks, voxels
from morpholake.sources import dicom, dicomweb, zarr


def element(group, el, vr, value, explicit=True):
    value += b" " * (len(value) % 2)
    if not explicit:
        return struct.pack("<HHI", group, el, len(value)) + value
    if vr.encode() in dicom.LONG_VR:
        return struct.pack("<HH2sHI", group, el, vr.encode(), 0, len(value)) + value
    return struct.pack("<HH2sH", group, el, vr.encode(), len(value)) + value


def dicom_file(syntax=dicom.EXPLICIT, frames=1, z=0.0, number=1, sequence=b""):
    explicit = syntax != dicom.IMPLICIT
    e = lambda *a: element(*a, explicit)
    pixels = np.arange(6 * frames, dtype="<i2") - 2
    body = b"".join([e(8, 0x60, "CS", b"CT"), sequence, e(0x20, 0xE, "UI", b"1.2.3"), e(0x20, 0x13, "IS", str(number).encode()), e(0x20, 0x32, "DS", f"0\\0\\{z}".encode()), e(0x20, 0x37, "DS", b"1\\0\\0\\0\\1\\0"), e(0x28, 8, "IS", str(frames).encode()), e(0x28, 0x10, "US", struct.pack("<H", 2)), e(0x28, 0x11, "US", struct.pack("<H", 3)), e(0x28, 0x30, "DS", b"0.5\\0.5"), e(0x28, 0x100, "US", struct.pack("<H", 16)), e(0x28, 0x103, "US", struct.pack("<H", 1)), e(0x28, 0x1052, "DS", b"-10"), e(0x28, 0x1053, "DS", b"2"), e(0x7FE0, 0x10, "OW", pixels.tobytes())])
    if syntax == dicom.DEFLATED:
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = c.compress(body) + c.flush()
    meta = element(2, 0x10, "UI", syntax.encode())
    return b"\0" * 128 + b"DICM" + element(2, 0, "UL", struct.pack("<I", len(meta))) + meta + body


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT, dicom.DEFLATED])
def test_dicom_frames(spark, tmp_path, syntax):
    (tmp_path / "a.dcm").write_bytes(dicom_file(syntax, frames=2, z=4.5))
    rows = dicom.frames(spark, str(tmp_path / "a.dcm")).orderBy("frame_index").collect()
    assert [r.pixels for r in rows] == [[-14.0, -12.0, -10.0, -8.0, -6.0, -4.0], [-2.0, 0.0, 2.0, 4.0, 6.0, 8.0]]
    assert rows[0].ipp == [0.0, 0.0, 4.5] and rows[0].series_uid == "1.2.3" and (rows[0]["rows"], rows[0]["cols"]) == (2, 3)
    assert dicom.frames(spark, str(tmp_path / "a.dcm"), pixels=False).first().pixels is None


def test_dicom_sequences_and_errors():
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(8, 0x60, "CS", b"MR") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    sequence = struct.pack("<HH2sHI", 8, 0x1140, b"SQ", 0, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert next(dicom.frames_of(dicom_file(sequence=sequence)))["modality"] == "CT"
    for bad, name in ((b"x" * 200, "dicom-magic"), (dicom_file("1.2.840.10008.1.2.4.50"), "transfer-syntax"), (dicom_file()[:-4], "dicom-short-element")):
        with pytest.raises(ValueError, match=name):
            list(dicom.frames_of(bad))


FRAME = "row_no long, series_uid string, rows int, cols int, iop array<double>, ipp array<double>, pixel_spacing array<double>, instance_number int, frame_index int"
IOP = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def stacked(spark, places, iop=IOP):
    rows = [(k, "s", 2, 3, iop, None if z is None else [0.0, 0.0, float(z)], [0.5, 0.5], k, 0) for k, z in enumerate(places)]
    frames = spark.createDataFrame(rows, FRAME)
    return frames, stacks.stacks(frames)


def test_stacks(spark):
    frames, out = stacked(spark, [10, 0, 5, 5.001, 0.001, 10.002])
    rows = {r.row_no: (r.phase, r.place) for r in out.collect()}
    assert rows == {1: (0, 0), 4: (1, 0), 2: (0, 1), 3: (1, 1), 0: (0, 2), 5: (1, 2)}
    assert sorted((r.slices, round(r.spacing, 3), r.uniform) for r in stacks.spacing(out, frames).collect()) == [(3, 5.0, True), (3, 5.001, True)]
    _, uneven = stacked(spark, [0, 0, 5])
    assert {(r.row_no, r.warning) for r in uneven.collect()} == {(0, "duplicate-position"), (2, "duplicate-position")}
    _, free = stacked(spark, [3, None, 1])
    assert [(r.row_no, r.warning) for r in free.orderBy("place").collect()] == [(0, "no-position"), (1, "no-position"), (2, "no-position")]


def test_dicom_json(spark):
    doc = {"0020000D": {"vr": "UI", "Value": ["1.2"]}, "0020000E": {"vr": "UI", "Value": ["1.2.1"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "A^B"}]}, "00080060": {"vr": "CS", "Value": ["CT"]}, "00200011": {"vr": "IS", "Value": [7]}, "00201208": {"vr": "IS", "Value": ["12"]}, "00080018": {"vr": "UI", "Value": ["9"]}}
    df = spark.createDataFrame([(json.dumps(doc),), ("{}",)], "json string")
    a, b = dicomweb.studies(df).collect()
    assert (a.study_uid, a.patient_name, a.modalities, a.n_instances) == ("1.2", "A^B", ["CT"], 12.0)
    assert (b.study_uid, b.patient_name, b.modalities) == ("", None, [])
    assert dicomweb.series(df).first().series_number == 7.0
    assert dicomweb.study_tree(dicomweb.instances(df)).count() == 2


def put_zarr(root, codec, separator):
    (root / "0").mkdir(parents=True)
    (root / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "0"}]}]}))
    meta = {"zarr_format": 2, "shape": [1, 2, 2, 5, 7], "chunks": [1, 1, 1, 4, 4], "dtype": "<u2", "order": "C", "compressor": {"id": codec} if codec else None, "fill_value": 9, "dimension_separator": separator}
    (root / "0" / ".zarray").write_text(json.dumps(meta))
    whole = np.arange(140, dtype="<u2").reshape(1, 2, 2, 5, 7)
    for c in range(2):
        for z in range(2):
            for y in range(2):
                for x in range(2):
                    if (c, z, y, x) == (1, 1, 1, 1):
                        continue  # a missing chunk is the fill value
                    chunk = np.zeros((1, 1, 1, 4, 4), "<u2")
                    part = whole[:, c : c + 1, z : z + 1, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
                    chunk[..., : part.shape[3], : part.shape[4]] = part
                    raw = chunk.tobytes()
                    name = root / "0" / separator.join(map(str, (0, c, z, y, x)))
                    name.parent.mkdir(parents=True, exist_ok=True)
                    name.write_bytes({"gzip": gzip.compress, "zlib": zlib.compress, None: bytes}[codec](raw))
    return whole


@pytest.mark.parametrize(("codec", "separator"), [(None, "."), ("gzip", "/"), ("zlib", ".")])
def test_zarr(spark, tmp_path, codec, separator):
    whole = put_zarr(tmp_path / "z", codec, separator)
    zarr.register(spark)
    read = spark.read.format("omezarr").load(f"file://{tmp_path}/z")
    got = np.full(whole.shape, -1.0)
    for r in read.collect():
        got[r.t, r.c, r.z, r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = np.array(r.data).reshape(r.height, r.width)
    want = whole.astype(float)
    want[0, 1, 1, 4:, 4:] = 9
    assert (got == want).all()
    assert {(r.c, r.z, r.chunk_y) for r in read.filter("c = 1 and z >= 1 and chunk_y in (0)").collect()} == {(1, 1, 0)}
    from pyspark.sql.datasource import EqualTo

    reader = zarr.ZarrReader({"path": f"file://{tmp_path}/z"})
    assert list(reader.pushFilters([EqualTo(("c",), 1), EqualTo(("width",), 4)])) == [EqualTo(("width",), 4)]
    assert sum(len(p.items) for p in reader.partitions()) == 8


def test_zarr_metadata():
    good = {"zarr_format": 2, "shape": [1] * 5, "chunks": [1] * 5, "dtype": "<u2", "order": "C", "compressor": None}
    for change, name in (({"zarr_format": 3}, "zarr-format"), ({"order": "F"}, "zarr-layout"), ({"dtype": "<c8"}, "zarr-dtype"), ({"compressor": {"id": "blosc"}}, "zarr-codec")):
        with pytest.raises(ValueError, match=name):
            zarr.parse_array(json.dumps(good | change).encode())


def test_quality(spark):
    uids = spark.createDataFrame([("1.2.840.10008.1.2",), ("1.2.840.10008.5.1.4.1.1.481.2",)], "u string")
    assert [r[0] for r in uids.select(quality.sop_family(F.col("u"))).collect()] == ["other", "rt_dose"]
    with pytest.raises(Exception, match="transfer-syntax"):
        uids.select(quality.checked_syntax(F.col("u"))).collect()
    people = spark.createDataFrame([("A", "1", "9.9", "20240101"), (None, "2", "9.9", None)], "patient_name string, patient_id string, study_uid string, study_date string")
    a, b = quality.anonymize(people).collect()
    assert (a.patient_name, b.patient_name, a.study_date) == ("ANON", None, None) and a.study_uid == b.study_uid != "9.9"
    assert quality.anonymize(people, keep_dates=True).first().study_date == "20240101"
    graded = quality.grade(spark.createDataFrame([(10.2, 10.0, "PR", "PR"), (12.0, 10.0, "PR", "PR")], "measured_sum double, published_sum double, picked string, published string"))
    assert [r.agree for r in graded.collect()] == [True, False]


def test_sobel_of_a_step(spark):
    img = spark.createDataFrame([(0, x, y, float(x >= 2)) for x in range(4) for y in range(3)], "tile int, x int, y int, v double")
    assert {(r.x, r.gradient) for r in voxels.sobel(img, 4, 3).collect()} == {(0, 0.0), (1, 4.0), (2, 4.0), (3, 0.0)}


def test_plates_and_wells(spark):
    plate = {"plate": {"name": "P", "rows": [{"name": "A"}], "columns": [{"name": "01"}, {"name": "02"}], "wells": [{"path": "A/02", "rowIndex": 0, "columnIndex": 1}]}}
    docs = lambda *d: spark.createDataFrame([(json.dumps(x),) for x in d], "attrs string")
    assert [tuple(r) for r in zarr.plate_wells(docs(plate, {"other": 1})).collect()] == [("P", "A/02", 0, 1, "A02")]
    for change in ({"rowIndex": 1}, {"columnIndex": -1}, {"path": None}):
        bad = {"plate": plate["plate"] | {"wells": [plate["plate"]["wells"][0] | change]}}
        with pytest.raises(Exception, match="plate-well"):
            zarr.plate_wells(docs(bad)).collect()
    assert [tuple(r) for r in zarr.well_images(docs({"well": {"images": [{"path": "0"}, {"path": "1"}]}}, {})).collect()] == [(0, "0"), (1, "1")]
    for bad in ({"well": {"images": []}}, {"well": {"images": [{"path": ""}]}}):
        with pytest.raises(Exception, match="well-images"):
            zarr.well_images(docs(bad)).collect()

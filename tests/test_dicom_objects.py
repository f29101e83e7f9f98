import struct

import numpy as np
import pytest

from morpholake.operators import voxels
from morpholake.sources import dicom, dicom_objects


def element(group, el, vr, value, explicit=True):
    value += b" " * (len(value) % 2)
    if not explicit:
        return struct.pack("<HHI", group, el, len(value)) + value
    if vr.encode() in dicom.LONG_VR:
        return struct.pack("<HH2sHI", group, el, vr.encode(), 0, len(value)) + value
    return struct.pack("<HH2sH", group, el, vr.encode(), len(value)) + value


def item(*parts, known=True):
    body = b"".join(parts)
    if known:
        return struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body
    return struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + body + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)


def sequence(group, el, *its, known=True, explicit=True):
    body = b"".join(its)
    n = len(body) if known else 0xFFFFFFFF
    head = struct.pack("<HH2sHI", group, el, b"SQ", 0, n) if explicit else struct.pack("<HHI", group, el, n)
    return head + body + (b"" if known else struct.pack("<HHI", 0xFFFE, 0xE0DD, 0))


def put(tmp_path, *parts, syntax=dicom.EXPLICIT):
    meta = element(2, 0x10, "UI", syntax.encode())
    (tmp_path / "a.dcm").write_bytes(b"\0" * 128 + b"DICM" + element(2, 0, "UL", struct.pack("<I", len(meta))) + meta + b"".join(parts))
    return str(tmp_path / "a.dcm")


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("explicit", [True, False])
def test_contours_to_mask(spark, tmp_path, known, explicit):
    e = lambda *a: element(*a, explicit)
    s = lambda g, el, *its: sequence(g, el, *its, known=known, explicit=explicit)
    square = e(0x3006, 0x50, "DS", b"1\\1\\7\\4\\1\\7\\4\\3\\7\\1\\3\\7")
    contour = item(e(0x3006, 0x42, "CS", b"CLOSED_PLANAR"), square, known=known)
    open_ = item(e(0x3006, 0x42, "CS", b"POINT"), square, known=known)
    path = put(tmp_path, s(0x3006, 0x20, item(e(0x3006, 0x22, "IS", b"2"), e(0x3006, 0x26, "LO", b"Liver"), known=known)), s(0x3006, 0x39, item(s(0x3006, 0x40, contour, open_), e(0x3006, 0x84, "IS", b"2"), known=known)), syntax=dicom.EXPLICIT if explicit else dicom.IMPLICIT)
    rows = dicom_objects.rows(spark, path, "contours")
    assert {(r.roi, r.name, r.z) for r in rows.collect()} == {(2, "Liver", 7.0)} and rows.count() == 4
    mask = voxels.rasterize(rows.selectExpr("roi", "z", "contour", "order", "x px", "y py"), 10)
    assert {(r.x, r.y) for r in mask.collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2)}


def test_segments(spark, tmp_path):
    bits = np.zeros(12, np.uint8)
    bits[[1, 5, 6]] = 1
    frame = lambda n, z: item(sequence(0x20, 0x9111, item(element(0x20, 0x9157, "UL", struct.pack("<I", n)))), sequence(0x20, 0x9113, item(element(0x20, 0x32, "DS", f"0\\0\\{z}".encode()))))
    us = lambda g, el, v: element(g, el, "US", struct.pack("<H", v))
    path = put(tmp_path, us(0x28, 0x10, 2), us(0x28, 0x11, 3), us(0x28, 0x100, 1), sequence(0x62, 2, item(us(0x62, 4, 2), element(0x62, 5, "LO", b"Tumour"))), sequence(0x5200, 0x9230, frame(1, 3), frame(2, 4)), element(0x7FE0, 0x10, "OB", np.packbits(bits, bitorder="little").tobytes()))
    assert sorted((r.segment, r.label or "", r.frame, r.z, r.i) for r in dicom_objects.rows(spark, path, "segments").collect()) == [(1, "", 0, 3.0, 1), (1, "", 0, 3.0, 5), (2, "Tumour", 1, 4.0, 0)]


def test_directory_and_beams(spark, tmp_path):
    rec = lambda kind, *more: item(element(4, 0x1430, "CS", kind), *more)
    path = put(tmp_path, sequence(4, 0x1220, rec(b"IMAGE", element(4, 0x1500, "CS", b"A\\0")), rec(b"STUDY", element(0x20, 0xD, "UI", b"1.1")), rec(b"SERIES", element(0x20, 0xE, "UI", b"1.2")), rec(b"IMAGE", element(4, 0x1500, "CS", b"B\\1"), element(0x20, 0x13, "IS", b"4")), rec(b"IMAGE")))
    assert [(r.study, r.series, r.instance_number, r.file_id) for r in dicom_objects.rows(spark, path, "directory").collect()] == [("", "", None, "A/0"), ("1.1", "1.2", 4, "B/1")]
    ref = lambda n, m: item(element(0x300A, 0x86, "DS", m), element(0x300C, 6, "IS", n))
    path = put(tmp_path, sequence(0x300A, 0x70, item(sequence(0x300C, 4, ref(b"1", b"5.5"))), item(sequence(0x300C, 4, ref(b"1", b"9")))), sequence(0x300A, 0xB0, item(element(0x300A, 0xC0, "IS", b"1"), element(0x300A, 0xC2, "LO", b"AP")), item(element(0x300A, 0xC0, "IS", b"2"))))
    assert [(r.beam, r.name, r.meterset) for r in dicom_objects.rows(spark, path, "beams").collect()] == [(1, "AP", 5.5), (2, None, None)]


def test_wrong_classes_are_refused():
    for read, name in ((dicom_objects.slide_of, "slide-class"), (dicom_objects.document_of, "document-class")):
        with pytest.raises(ValueError, match=name):
            list(read({(8, 0x16): b"1.2.3"}))
    assert list(dicom_objects.regions_of({})) == []

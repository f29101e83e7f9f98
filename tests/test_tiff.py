import struct
import zlib

import numpy as np
import pytest

from morpholake.sources import tiff

OME = b'<OME><Image><Pixels DimensionOrder="XYCZT" SizeC="2" SizeZ="2" SizeT="1" Type="uint16"/></Image></OME>\0'


def lzw_plain(data):
    """Codes of nine bits only, with a clear before the table would need ten."""
    codes, out = [], 0
    for k, b in enumerate(data):
        if k % 200 == 0:
            codes.append(256)
        codes.append(b)
    for c in [*codes, 257]:
        out = out << 9 | c
    n = 9 * (len(codes) + 1)
    pad = -n % 8
    return (out << pad).to_bytes((n + pad) // 8, "big")


def tiff_file(images, order="<", compression=1, tile=None, rows_per_strip=2, predictor=1, head=None):
    out, ends = bytearray(b"II*\0\0\0\0\0" if order == "<" else b"MM\0*\0\0\0\0"), 4
    pack = {1: bytes, 8: zlib.compress, 5: lzw_plain, 7: bytes}[compression]
    for image in images:
        h, w = image.shape
        image = image.astype(image.dtype.newbyteorder(order))
        if predictor == 2:
            image = np.concatenate([image[:, :1], np.diff(image.astype(np.int64), axis=1).astype(image.dtype)], axis=1).astype(image.dtype)
        if tile:
            padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), image.dtype)
            padded[:h, :w] = image
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for b in blocks:
            offsets.append(len(out))
            out += (raw := pack(b.tobytes()))
            counts.append(len(raw))
        fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [image.dtype.itemsize * 8]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]])]
        fields += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 3, [rows_per_strip]), (279, 4, counts)]
        if head:
            fields.append((270, 2, head))
        body = b""
        extra = len(out)
        for tag, kind, v in sorted(fields):
            raw = v if kind == 2 else struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
            if len(raw) > 4:
                at, out = len(out), out + raw
                raw = struct.pack(f"{order}I", at)
            body += struct.pack(f"{order}HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
        assert extra <= len(out)
        struct.pack_into(f"{order}I", out, ends, len(out))
        out += struct.pack(f"{order}H", len(fields)) + body
        ends = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "tile", "predictor"), [(1, None, 1), (8, None, 2), (5, None, 1), (1, 4, 1), (8, 4, 1)])
@pytest.mark.parametrize("kind", ["u1", "i2", "f4"])
def test_planes(order, compression, tile, predictor, kind):
    if kind == "f4" and predictor == 2:
        pytest.skip("differences are of integers")
    image = (np.arange(35).reshape(5, 7) * 3 - (0 if kind == "u1" else 50)).astype(kind)
    (o, f), = tiff.directories(tiff_file([image], order, compression, tile, predictor=predictor))
    w, h, dtype, values = tiff.plane_of(tiff_file([image], order, compression, tile, predictor=predictor), o, f)
    assert (w, h, dtype) == (7, 5, kind) and values.tolist() == image.astype(float).ravel().tolist()


def test_ome(spark, tmp_path):
    (tmp_path / "a.ome.tif").write_bytes(tiff_file([np.full((2, 3), k, np.uint16) for k in range(4)], head=OME))
    rows = tiff.planes(spark, str(tmp_path / "a.ome.tif")).orderBy("plane").collect()
    assert [(r.t, r.c, r.z, r.data[0]) for r in rows] == [(0, 0, 0, 0.0), (0, 1, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 1, 3.0)]


def test_errors():
    with pytest.raises(ValueError, match="tiff-magic"):
        list(tiff.directories(b"none at all"))
    raw = tiff_file([np.zeros((2, 2), np.uint8)], compression=7)
    with pytest.raises(ValueError, match="tiff-compression"):
        tiff.plane_of(raw, *next(tiff.directories(raw)))
    with pytest.raises(ValueError, match="tiff-lzw-code"):
        tiff.lzw(b"\xff\xfe\xff")


def test_lzw_grows_its_table():
    """Codes as a common encoder makes them, of ten bits and more."""

    def encode(data):
        table, out, bits, width = {bytes([i]): i for i in range(256)}, 256, 9, 9
        w, size = b"", 258

        def put(code):
            nonlocal out, bits
            out, bits = out << width | code, bits + width

        for b in data:
            if w + bytes([b]) in table:
                w += bytes([b])
                continue
            put(table[w])
            table[w + bytes([b])] = size
            size += 1
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
            w = bytes([b])
        put(table[w])
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        put(257)
        pad = -bits % 8
        return (out << pad).to_bytes((bits + pad) // 8, "big")

    data = bytes((k * k // 7) % 251 for k in range(2500))
    assert tiff.lzw(encode(data)) == data

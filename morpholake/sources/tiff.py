"""TIFF and OME-TIFF files as one row per plane: strips or tiles, stored plainly, deflated or as LZW."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PLANE = T.StructType([T.StructField("path", T.StringType(), False), *(T.StructField(c, T.IntegerType(), False) for c in ("plane", "t", "c", "z", "width", "height")), T.StructField("dtype", T.StringType(), False), T.StructField("data", T.ArrayType(T.DoubleType(), False), False)])
#: Bytes and struct codes of field types; compressions.
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)


def lzw(data: bytes) -> bytes:
    """Variable-width codes, highest bit first, from 9 to 12 bits."""
    out = bytearray()
    table: list[bytes] = []
    bits = held = 0
    width, before = 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if not table or code > len(table):
                raise ValueError("tiff-lzw-code")
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, fields) of every image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("tiff-magic")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields = {}
        n = struct.unpack_from(f"{order}H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind not in FIELD_TYPES:
                continue
            code = FIELD_TYPES[kind]
            form = f"{order}{count}{code}"
            size = struct.calcsize(form)
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
            fields[tag] = struct.unpack_from(form, data, place)
        yield order, fields
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def plane_of(data: bytes, order: str, f: dict[int, tuple]) -> tuple[int, int, str, np.ndarray]:
    """(width, height, dtype, values) of one directory of one sample per pixel."""
    width, height = f[256][0], f[257][0]
    bits, compression = f.get(258, (8,))[0], f.get(259, (PLAIN,))[0]
    if f.get(277, (1,))[0] != 1:
        raise ValueError("tiff-samples: want one sample per pixel")
    letter = {1: "u", 2: "i", 3: "f"}.get(f.get(339, (1,))[0], "u")
    kind = np.dtype(f"{order}{letter}{bits // 8}")
    tiled = 322 in f
    tw, th = (f[322][0], f[323][0]) if tiled else (width, min(height, f.get(278, (height,))[0]))
    offsets, counts = (f[324], f[325]) if tiled else (f[273], f[279])
    across = -(-width // tw)
    out = np.zeros((height, width))
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        raw = data[at : at + n]
        if compression in DEFLATE:
            raw = zlib.decompress(raw)
        elif compression == LZW:
            raw = lzw(raw)
        elif compression != PLAIN:
            raise ValueError(f"tiff-compression: {compression}")
        y, x = k // across * th, k % across * tw
        h = th if tiled else min(th, height - y)
        block = np.frombuffer(raw, kind, h * tw).reshape(h, tw)
        if f.get(317, (1,))[0] == 2:  # differences along the row
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + h, x : x + tw] = block[: height - y, : width - x]
    return width, height, f"{letter}{bits // 8}", out.ravel()


def ome_index(description: str, k: int) -> tuple[int, int, int]:
    """(t, c, z) of the k-th plane from the order and sizes of the OME header; (0, 0, k) without one."""
    m = re.search(r"<Pixels\b[^>]*>", description)
    if not m:
        return 0, 0, k
    value = lambda name, other: (re.search(rf'\b{name}="([^"]*)"', m[0]) or [None, other])[1]
    place = {}
    for axis in value("DimensionOrder", "XYZCT")[2:]:
        size = int(value(f"Size{axis}", "1"))
        place[axis], k = k % size, k // size
    return place.get("T", 0), place.get("C", 0), place.get("Z", 0)


def planes(spark: SparkSession, path: str) -> DataFrame:
    """PLANE rows of every file under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, head = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), ""
                for k, (order, f) in enumerate(directories(data)):
                    if k == 0 and 270 in f:
                        head = f[270][0].rstrip(b"\0").decode("utf-8", "replace")
                    width, height, kind, values = plane_of(data, order, f)
                    ints = [k, *ome_index(head, k), width, height]
                    flat = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([v], pa.int32()) for v in ints), pa.array([kind]), flat], names=PLANE.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PLANE)

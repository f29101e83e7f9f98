"""DICOM Part-10 files as one row per frame: explicit and implicit little endian, pixels that are not compressed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Value representations with a long length field, and those of the tags that are read when they are implicit.
LONG_VR = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"}
IMPLICIT_VR = {(0x28, 0x8): b"IS", (0x28, 0x10): b"US", (0x28, 0x11): b"US", (0x28, 0x100): b"US", (0x28, 0x103): b"US", (0x28, 0x2): b"US"}
IMPLICIT, EXPLICIT, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99"
PIXELS = (0x7FE0, 0x10)

FRAME = T.StructType(
    [T.StructField("path", T.StringType(), False), T.StructField("frame_index", T.IntegerType(), False), T.StructField("series_uid", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType(), False)) for c in ("ipp", "iop", "pixel_spacing")]
    + [T.StructField("instance_number", T.IntegerType()), T.StructField("slope", T.DoubleType(), False), T.StructField("intercept", T.DoubleType(), False), T.StructField("pixels", T.ArrayType(T.DoubleType(), False))]
)


def elements(data: bytes, at: int, explicit: bool, end: int | None = None) -> Iterator[tuple[tuple[int, int], bytes, bytes]]:
    """(tag, vr, value) of the top-level elements; sequences are passed over."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        group, element = struct.unpack_from("<HH", data, at)
        if explicit and group != 0xFFFE:
            vr = data[at + 4 : at + 6]
            n, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in LONG_VR else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
        else:
            vr, n, at = IMPLICIT_VR.get((group, element), b"UN"), struct.unpack_from("<I", data, at + 4)[0], at + 8
        if n == 0xFFFFFFFF:
            if (group, element) == PIXELS:
                raise ValueError("dicom-compressed-pixels")
            at = _past_sequence(data, at, explicit)
            continue
        if at + n > end:
            raise ValueError(f"dicom-short-element: {group:04x}{element:04x}")
        yield (group, element), vr, data[at : at + n]
        at += n


def _past_sequence(data: bytes, at: int, explicit: bool) -> int:
    """The place after a sequence or item of undefined length."""
    while at + 8 <= len(data):
        group, element, n = struct.unpack_from("<HHI", data, at)
        if (group, element) == (0xFFFE, 0xE0DD) or (group, element) == (0xFFFE, 0xE00D):
            return at + 8
        if (group, element) == (0xFFFE, 0xE000):
            at = _past_sequence(data, at + 8, explicit) if n == 0xFFFFFFFF else at + 8 + n
        else:  # an element of an item of undefined length
            vr = data[at + 4 : at + 6]
            if explicit:
                n, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in LONG_VR else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
            else:
                at += 8
            at = _past_sequence(data, at, explicit) if n == 0xFFFFFFFF else at + n
    raise ValueError("dicom-open-sequence")


def body_of(data: bytes) -> tuple[str, bytes]:
    """(transfer syntax, the bytes after the file's own header) of one file."""
    if data[128:132] != b"DICM":
        raise ValueError("dicom-magic")
    meta_end = 132 + 12 + struct.unpack_from("<I", data, 140)[0]
    meta = {tag: v for tag, _, v in elements(data, 132, True, meta_end)}
    return meta.get((2, 0x10), b"").rstrip(b"\0 ").decode(), data[meta_end:]


Values = dict[tuple[int, int], tuple[bytes, bytes]]


def values_before_pixels(body: bytes) -> tuple[Values, int | None]:
    """(top-level elements, where the first fragment of encapsulated pixels begins) of an explicit body."""
    at = body.find(struct.pack("<HH", *PIXELS))
    while at >= 0:  # the tag's bytes can stand in a value too: it is the one that elements before it lead to
        try:
            found = {tag: (vr, v) for tag, vr, v in elements(body, 0, True, at)}
        except (ValueError, struct.error):
            found = None
        if found is not None and body[at + 8 : at + 12] == b"\xff\xff\xff\xff":
            return found, at + 12
        at = body.find(struct.pack("<HH", *PIXELS), at + 1)
    return {tag: (vr, v) for tag, vr, v in elements(body, 0, True)}, None


def header_of(found: Values) -> dict:
    """What the frames of a file share."""
    text = lambda g, e: found[g, e][1].rstrip(b"\0 ").decode("latin-1") if (g, e) in found else None
    numbers = lambda g, e: [float(x) for x in s.split("\\")] if (s := text(g, e)) else None
    short = lambda g, e, default=None: struct.unpack("<H", found[g, e][1][:2])[0] if (g, e) in found else default
    instance = numbers(0x20, 0x13)
    return {
        "series_uid": text(0x20, 0xE), "modality": text(8, 0x60), "rows": short(0x28, 0x10), "cols": short(0x28, 0x11), "ipp": numbers(0x20, 0x32), "iop": numbers(0x20, 0x37), "pixel_spacing": numbers(0x28, 0x30),
        "instance_number": None if instance is None else int(instance[0]), "slope": (numbers(0x28, 0x1053) or [1.0])[0], "intercept": (numbers(0x28, 0x1052) or [0.0])[0],
        "bits": short(0x28, 0x100, 16), "signed": bool(short(0x28, 0x103, 0)), "samples": short(0x28, 2, 1), "n_frames": int((numbers(0x28, 8) or [1])[0]),
    }


def frames_of(data: bytes) -> Iterator[dict]:
    """The frames of one file whose pixels are not compressed."""
    syntax, body = body_of(data)
    if syntax not in (IMPLICIT, EXPLICIT, DEFLATED):
        raise ValueError(f"transfer-syntax: {syntax or 'none'}")
    body = zlib.decompress(body, -15) if syntax == DEFLATED else body
    found = {tag: (vr, v) for tag, vr, v in elements(body, 0, syntax != IMPLICIT)}
    head = header_of(found)
    pixels, n_frames = None, head["n_frames"]
    if PIXELS in found and head["rows"] and head["cols"]:
        kind = np.dtype(f"<{'i' if head['signed'] else 'u'}{head['bits'] // 8}")
        size = head["rows"] * head["cols"] * head["samples"]
        raw = np.frombuffer(found[PIXELS][1], kind, min(n_frames * size, len(found[PIXELS][1]) // kind.itemsize))
        if len(raw) < n_frames * size:
            raise ValueError("dicom-short-pixels")
        pixels = raw.reshape(n_frames, size).astype(np.float64)
    for k in range(n_frames):
        yield head | {"frame_index": k, "pixels": None if pixels is None else pixels[k] * head["slope"] + head["intercept"]}


def frames(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """FRAME rows of every file under path; pixels=False leaves the pixel arrays null."""
    number = pa.list_(pa.float64())
    schema = pa.schema([("path", pa.string()), ("frame_index", pa.int32()), ("series_uid", pa.string()), ("modality", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("ipp", number), ("iop", number), ("pixel_spacing", number), ("instance_number", pa.int32()), ("slope", pa.float64()), ("intercept", pa.float64()), ("pixels", number)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                for f in frames_of(batch.column(1)[k].as_py()):
                    row = f | {"path": name} | ({} if pixels else {"pixels": None})
                    yield pa.RecordBatch.from_arrays([pa.array([row[c.name]], c.type) for c in schema], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FRAME)

"""DICOM objects that are not images: contours, segmentations, directories, plans and ultrasound regions, as rows.

Every reader is binaryFile plus one small extractor per file; the rows then join, aggregate and rasterise as any table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dicom import DEFLATED, EXPLICIT, IMPLICIT, LONG_VR, elements

Data = dict[tuple[int, int], object]
#: Tags whose value is a sequence, for files that do not say so.
SEQUENCES = {(0x3006, 0x20), (0x3006, 0x39), (0x3006, 0x40), (0x3006, 0x80), (0x62, 2), (0x5200, 0x9230), (0x20, 0x9111), (0x20, 0x9113), (4, 0x1220), (0x18, 0x6011), (0x300A, 0xB0), (0x300A, 0x70), (0x300C, 4)}


def dataset(data: bytes, at: int, end: int, explicit: bool) -> tuple[Data, int]:
    """A dataset from `at`, to `end` or its item's delimiter: sequences as lists of datasets, all else as bytes."""
    out: Data = {}
    while at + 8 <= end:
        group, element = struct.unpack_from("<HH", data, at)
        if (group, element) == (0xFFFE, 0xE00D):
            return out, at + 8
        if explicit:
            vr = data[at + 4 : at + 6]
            n, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in LONG_VR else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
        else:
            vr, n, at = b"SQ" if (group, element) in SEQUENCES else b"UN", struct.unpack_from("<I", data, at + 4)[0], at + 8
        if vr == b"SQ" or n == 0xFFFFFFFF:
            out[group, element], at = _items(data, at, end if n == 0xFFFFFFFF else at + n, explicit)
            continue
        if at + n > end:
            raise ValueError(f"dicom-short-element: {group:04x}{element:04x}")
        out[group, element] = data[at : at + n]
        at += n
    return out, at


def _items(data: bytes, at: int, end: int, explicit: bool) -> tuple[list[Data], int]:
    out: list[Data] = []
    while at + 8 <= end:
        group, element, n = struct.unpack_from("<HHI", data, at)
        at += 8
        if (group, element) == (0xFFFE, 0xE0DD):
            return out, at
        if (group, element) != (0xFFFE, 0xE000):
            raise ValueError("dicom-bad-item")
        item, after = dataset(data, at, end if n == 0xFFFFFFFF else at + n, explicit)
        out.append(item)
        at = after if n == 0xFFFFFFFF else at + n
    return out, at


def read(content: bytes) -> Data:
    if content[128:132] != b"DICM":
        raise ValueError("dicom-magic")
    start = 144 + struct.unpack_from("<I", content, 140)[0]
    meta = {tag: v for tag, _, v in elements(content, 132, True, start)}
    syntax = meta.get((2, 0x10), b"").rstrip(b"\0 ").decode()
    if syntax not in (IMPLICIT, EXPLICIT, DEFLATED):
        raise ValueError(f"transfer-syntax: {syntax or 'none'}")
    body = zlib.decompress(content[start:], -15) if syntax == DEFLATED else content[start:]
    return dataset(body, 0, len(body), syntax != IMPLICIT)[0]


def text(d: Data, *tag: int) -> str | None:
    v = d.get(tag)  # type: ignore[call-overload]
    return v.rstrip(b"\0 ").decode("latin-1") if isinstance(v, bytes) else None


def numbers(d: Data, *tag: int) -> list[float]:
    return [float(x) for x in (text(d, *tag) or "").split("\\") if x.strip()]


def items(d: Data, *tag: int) -> list[Data]:
    v = d.get(tag)  # type: ignore[call-overload]
    return v if isinstance(v, list) else []


def short(d: Data, *tag: int) -> int | None:
    v = d.get(tag)  # type: ignore[call-overload]
    return struct.unpack("<H", v[:2])[0] if isinstance(v, bytes) and len(v) >= 2 else None


def contours_of(d: Data) -> Iterator[tuple]:
    """(roi, name, contour, order, x, y, z) of closed planar contours; a region without a name is `ROI n`."""
    names = {(numbers(r, 0x3006, 0x22) or [0])[0]: text(r, 0x3006, 0x26) for r in items(d, 0x3006, 0x20)}
    for r in items(d, 0x3006, 0x39):
        roi = int((numbers(r, 0x3006, 0x84) or [0])[0])
        for k, c in enumerate(items(r, 0x3006, 0x40)):
            if (text(c, 0x3006, 0x42) or "CLOSED_PLANAR") != "CLOSED_PLANAR":
                continue
            p = numbers(c, 0x3006, 0x50)
            for i in range(len(p) // 3):
                yield roi, names.get(roi) or f"ROI {roi}", k, i, p[3 * i], p[3 * i + 1], p[2]


def segments_of(d: Data) -> Iterator[tuple]:
    """(segment, label, frame, z, i): set pixels of a one-bit segmentation, i running over rows."""
    rows, cols, bits = short(d, 0x28, 0x10) or 0, short(d, 0x28, 0x11) or 0, short(d, 0x28, 0x100)
    if bits != 1:
        raise ValueError(f"seg-bits: {bits}")
    labels = {short(s, 0x62, 4): text(s, 0x62, 5) for s in items(d, 0x62, 2)}
    on = np.unpackbits(np.frombuffer(d.get((0x7FE0, 0x10), b""), np.uint8), bitorder="little")  # type: ignore[arg-type]
    frames = items(d, 0x5200, 0x9230) or [{}] * int((numbers(d, 0x28, 8) or [1])[0])
    for k, f in enumerate(frames):
        content, place = (items(f, 0x20, 0x9111) or [{}])[0], (items(f, 0x20, 0x9113) or [{}])[0]
        index = content.get((0x20, 0x9157))
        segment = struct.unpack("<I", index[:4])[0] if isinstance(index, bytes) else 1
        z = (numbers(place, 0x20, 0x32) or [0, 0, float(k)])[2]
        for i in np.flatnonzero(on[k * rows * cols : (k + 1) * rows * cols]).tolist():
            yield segment, labels.get(segment), k, z, i


def directory_of(d: Data) -> Iterator[tuple]:
    """(study, series, instance_number, file_id): images of a directory under the study and series last seen before them."""
    study = series = None
    for r in items(d, 4, 0x1220):
        kind = text(r, 4, 0x1430)
        if kind == "STUDY":
            study, series = text(r, 0x20, 0xD), None
        elif kind == "SERIES":
            series = text(r, 0x20, 0xE)
        elif kind == "IMAGE" and text(r, 4, 0x1500):
            number = numbers(r, 0x20, 0x13)
            yield study or "", series or "", int(number[0]) if number else None, text(r, 4, 0x1500).replace("\\", "/")


def beams_of(d: Data) -> Iterator[tuple]:
    """(beam, name, meterset): beams with the meterset of the first fraction group that names them."""
    sets: dict[int, float] = {}
    for g in items(d, 0x300A, 0x70):
        for b in items(g, 0x300C, 4):
            if (n := numbers(b, 0x300C, 6)) and (m := numbers(b, 0x300A, 0x86)):
                sets.setdefault(int(n[0]), m[0])
    for b in items(d, 0x300A, 0xB0):
        n = int((numbers(b, 0x300A, 0xC0) or [0])[0])
        yield n, text(b, 0x300A, 0xC2), sets.get(n)


def real(d: Data, *tag: int) -> float | None:
    """A binary double of a dataset."""
    v = d.get(tag)  # type: ignore[call-overload]
    return struct.unpack("<d", v[:8])[0] if isinstance(v, bytes) and len(v) >= 8 else None


def long(d: Data, *tag: int) -> int | None:
    v = d.get(tag)  # type: ignore[call-overload]
    return struct.unpack("<I", v[:4])[0] if isinstance(v, bytes) and len(v) >= 4 else None


def regions_of(d: Data) -> Iterator[tuple]:
    """(region, format, x0, y0, x1, y1, units_x, units_y, delta_x, delta_y) of an ultrasound image's regions."""
    for k, r in enumerate(items(d, 0x18, 0x6011)):
        yield k, short(r, 0x18, 0x6012), *(long(r, 0x18, e) for e in (0x6018, 0x601A, 0x601C, 0x601E)), short(r, 0x18, 0x6024), short(r, 0x18, 0x6026), real(r, 0x18, 0x602C), real(r, 0x18, 0x602E)


#: The classes of whole-slide images and encapsulated documents.
SLIDE_CLASS, DOCUMENT_CLASSES = "1.2.840.10008.5.1.4.1.1.77.1.6", ("1.2.840.10008.5.1.4.1.1.104.1", "1.2.840.10008.5.1.4.1.1.104.2")


def slide_of(d: Data) -> Iterator[tuple]:
    """(total_cols, total_rows, tiles, optical_paths): the grid of a whole-slide image; what it lacks is null."""
    if text(d, 8, 0x16) != SLIDE_CLASS:
        raise ValueError(f"slide-class: {text(d, 8, 0x16)}")
    yield long(d, 0x48, 6) or None, long(d, 0x48, 7) or None, len(items(d, 0x48, 0x21A)), len(items(d, 0x48, 0x105)) or None


def document_of(d: Data) -> Iterator[tuple]:
    """(title, mime, size) of an encapsulated document."""
    if text(d, 8, 0x16) not in DOCUMENT_CLASSES:
        raise ValueError(f"document-class: {text(d, 8, 0x16)}")
    body = d.get((0x42, 0x11))
    yield text(d, 0x42, 0x10), text(d, 0x42, 0x12), len(body) if isinstance(body, bytes) else 0


#: What a reader makes: columns and extractor.
KINDS: dict[str, tuple[str, Callable[[Data], Iterator[tuple]]]] = {
    "contours": ("roi int, name string, contour int, order int, x double, y double, z double", contours_of),
    "segments": ("segment int, label string, frame int, z double, i int", segments_of),
    "directory": ("study string, series string, instance_number int, file_id string", directory_of),
    "beams": ("beam int, name string, meterset double", beams_of),
    "regions": ("region int, format int, x0 int, y0 int, x1 int, y1 int, units_x int, units_y int, delta_x double, delta_y double", regions_of),
    "slides": ("total_cols int, total_rows int, tiles int, optical_paths int", slide_of),
    "documents": ("title string, mime string, size int", document_of),
}


def rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path and the columns of KINDS[kind], for every file under path."""
    columns, extract = KINDS[kind]
    schema = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(columns).fields])
    arrow = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [pa.string(), *(arrow[f.dataType.simpleString()] for f in schema.fields[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, out = batch.column(0)[k].as_py(), []
                for row in extract(read(batch.column(1)[k].as_py())):
                    out.append((name, *row))
                    if len(out) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def region_spacing(regions: DataFrame) -> DataFrame:
    """path, row_mm, col_mm of the first plane region of each file whose axes are in cm with positive steps."""
    fit = regions.filter("format = 1 and units_x = 3 and units_y = 3 and delta_x > 0 and delta_y > 0")
    first = fit.groupBy("path").agg(F.min_by(F.struct("delta_x", "delta_y"), "region").alias("r"))
    return first.select("path", (F.col("r.delta_y") * 10).alias("row_mm"), (F.col("r.delta_x") * 10).alias("col_mm"))

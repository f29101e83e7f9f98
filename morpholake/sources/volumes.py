"""Image volumes: NIfTI-1 and NRRD files as one row per frame, and NIfTI bytes of a frame.

Files are found and listed by Spark's binaryFile reader, on any store; a task decodes whole files, so the largest file
bounds its memory.  frames() keep a frame as an array; voxels() turns frames into the long form that the operators take."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = T.StructType(
    [T.StructField("series", T.StringType(), False), T.StructField("t", T.IntegerType(), False)]
    + [T.StructField(c, T.IntegerType(), False) for c in ("nx", "ny", "nz")]
    + [T.StructField(c, T.DoubleType(), False) for c in ("sx", "sy", "sz")]
    + [T.StructField("dtype", T.StringType(), False), T.StructField("data", T.ArrayType(T.DoubleType(), False), False)]
)
#: Data types of NIfTI-1 by code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
#: Data types of NRRD by name.
NRRD_TYPES = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "char": "i1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "float": "f4", "double": "f8"}


def nifti_frames(content: bytes) -> Iterator[tuple[int, tuple[int, int, int], tuple[float, float, float], str, np.ndarray]]:
    """(t, dims, spacing, dtype, scaled values) of every frame; gzip is seen by its first bytes."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if len(content) < 348:
        raise ValueError("nifti-short-header")
    order = "<" if struct.unpack_from("<i", content)[0] == 348 else ">"
    if struct.unpack_from(f"{order}i", content)[0] != 348:
        raise ValueError("nifti-bad-header")
    dim = struct.unpack_from(f"{order}8h", content, 40)
    code = struct.unpack_from(f"{order}h", content, 70)[0]
    if code not in NIFTI_TYPES:
        raise ValueError(f"nifti-datatype: {code}")
    pixdim = struct.unpack_from(f"{order}8f", content, 76)
    offset, slope, inter = struct.unpack_from(f"{order}3f", content, 108)
    dims = tuple(max(1, d) if k < dim[0] else 1 for k, d in enumerate(dim[1:4]))
    n, kind = int(np.prod(dims)), np.dtype(order + NIFTI_TYPES[code])
    frames = max(1, dim[4]) if dim[0] > 3 else 1
    if len(content) < int(offset) + n * frames * kind.itemsize:
        raise ValueError("nifti-short-data")
    for t in range(frames):
        raw = np.frombuffer(content, kind, n, int(offset) + t * n * kind.itemsize).astype(np.float64)
        yield t, dims, tuple(abs(float(p)) or 1.0 for p in pixdim[1:4]), NIFTI_TYPES[code], raw * slope + inter if slope else raw


def nifti_bytes(dims: tuple[int, int, int], spacing: tuple[float, float, float], data: np.ndarray) -> bytes:
    """A NIfTI-1 file of one float64 frame."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *dims, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *spacing, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(data, "<f8").tobytes()


def nrrd_frames(content: bytes) -> Iterator[tuple[int, tuple[int, int, int], tuple[float, float, float], str, np.ndarray]]:
    """The one frame of a three-dimensional NRRD file: raw, gzip or ascii, attached data."""
    if not content.startswith(b"NRRD"):
        raise ValueError("nrrd-magic")
    head, _, body = content.partition(b"\n\n") if b"\r\n\r\n" not in content[:4096] else content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^#:\n]+):=?(.*)$", head.decode("latin-1"), re.M)}
    if fields.get("dimension") != "3":
        raise ValueError(f"nrrd-dimension: {fields.get('dimension')}")
    dims = tuple(int(x) for x in fields["sizes"].split())
    if fields["type"].lower() not in NRRD_TYPES:
        raise ValueError(f"nrrd-type: {fields['type']}")
    kind = np.dtype((">" if fields.get("endian", "little").lower() == "big" else "<") + NRRD_TYPES[fields["type"].lower()])
    encoding, n = fields.get("encoding", "raw").lower(), int(np.prod(dims))
    if encoding in ("gzip", "gz"):
        body = gzip.decompress(body)
    data = np.array(body.split(), np.float64) if encoding in ("ascii", "txt", "text") else np.frombuffer(body, kind, min(n, len(body) // kind.itemsize)).astype(np.float64)
    if len(data) < n:
        raise ValueError("nrrd-short-data")
    if "space directions" in fields:
        spacing = tuple(float(np.linalg.norm([float(x) for x in v.split(",")])) for v in re.findall(r"\(([^)]*)\)", fields["space directions"]))
    else:
        spacing = tuple(float(x) for x in fields.get("spacings", "1 1 1").split())
    yield 0, dims, spacing, kind.str[1:], data[:n]


FORMATS = {"nifti": nifti_frames, "nrrd": nrrd_frames}


def frames(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """FRAMES of every file under path."""
    decode = FORMATS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for t, dims, spacing, dtype, data in decode(content):
                    row = [[name], [t], *([d] for d in dims), *([s] for s in spacing), [dtype]]
                    kinds = [pa.string(), pa.int32(), *[pa.int32()] * 3, *[pa.float64()] * 3, pa.string()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, x) for v, x in zip(row, kinds, strict=True)), pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))], names=FRAMES.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FRAMES)


def voxels(frames_: DataFrame) -> DataFrame:
    """series, t, x, y, z, v: x runs fastest."""
    long_ = frames_.select("series", "t", "nx", "ny", F.posexplode("data").alias("i", "v"))
    return long_.select("series", "t", (F.col("i") % F.col("nx")).alias("x"), (F.floor(F.col("i") / F.col("nx")) % F.col("ny")).cast("int").alias("y"), F.floor(F.col("i") / (F.col("nx") * F.col("ny"))).cast("int").alias("z"), "v")


#: Format by the first bytes of a file.
MAGIC = (("nrrd", 0, b"NRRD"), ("gzip", 0, b"\x1f\x8b"), ("tiff", 0, b"II*\0"), ("tiff", 0, b"MM\0*"), ("dicom", 128, b"DICM"), ("nifti", 344, b"n+1\0"), ("nifti", 344, b"ni1\0"), ("pdf", 0, b"%PDF"), ("png", 0, b"\x89PNG"))


def sniff(content: Column) -> Column:
    """The format of binary content by its first bytes, null if none is known."""
    out = F.lit(None).cast("string")
    for name, at, mark in reversed(MAGIC):
        out = F.when(F.substring(content, at + 1, len(mark)) == F.lit(bytearray(mark)), name).otherwise(out)
    return out

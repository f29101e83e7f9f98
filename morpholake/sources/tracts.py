"""Streamline files as point tables: TrackVis (.trk) and MRtrix (.tck), split into spans of whole streamlines.

A file's header is read first.  Triplets of a .tck are of fixed size, so any aligned cut will do: a span begins after the first
end mark in it.  A .trk tells each streamline's length before its points, so a scan over these lengths alone cuts it.  Spans then
spread over tasks, each reading its own bytes.  A streamline is named by the place of its first byte."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Marks and sizes of the formats.
TRK_MARK, TRK_HEAD, TCK_MARK = b"TRAC", 1000, b"mrtrix tracks"
GZIP_MARK, ZSTD_MARK = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
MOST_POINTS = 100_000_000
SPAN_BYTES = 32_000_000
SPAN = T.StructType([*(T.StructField(c, T.StringType()) for c in ("path", "kind")), *(T.StructField(c, T.LongType()) for c in ("begin", "stop"))])
POINT = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("k", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "xyz"), T.StructField("scalars", T.ArrayType(T.FloatType()))])


def opened(path: str) -> pa.NativeFile:
    """A file of any store that its uri names; one that is compressed as a whole is unpacked in memory."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    store, place = fs.FileSystem.from_uri(uri)
    f = store.open_input_file(place)
    mark = f.read(4)
    f.seek(0)
    if mark == ZSTD_MARK:
        raise ValueError("trk-zstd")
    if mark[:2] != GZIP_MARK:
        return f
    try:
        return pa.BufferReader(gzip.decompress(f.read()))
    except (OSError, EOFError) as e:
        raise ValueError(f"trk-gzip: {e}") from e


def trk_header(head: bytes) -> tuple[int, int, np.ndarray | None]:
    """(scalars per point, properties per streamline, matrix to the world or None)."""
    if len(head) < TRK_HEAD:
        raise ValueError(f"trk-too-small: {len(head)}")
    if head[:4] != TRK_MARK:
        raise ValueError("trk-magic")
    version, size = struct.unpack_from("<II", head, 992)
    if version > 3 or size != TRK_HEAD:
        raise ValueError(f"trk-version: {version}, {size}")
    scalars, properties = struct.unpack_from("<h", head, 36)[0], struct.unpack_from("<h", head, 238)[0]
    if not (0 <= scalars <= 1024 and 0 <= properties <= 1024):
        raise ValueError(f"trk-scalars: {scalars}, {properties}")
    matrix = np.frombuffer(head, "<f4", 16, 440).astype(np.float64).reshape(4, 4)
    return scalars, properties, matrix if matrix[3, 3] else None


def tck_offset(head: bytes) -> int:
    """Where the triplets begin."""
    first, _, rest = head.lstrip(b"\n").partition(b"\n")
    if TCK_MARK not in first:
        raise ValueError("tck-signature")
    offset = None
    for line in rest.split(b"\n"):
        text = line.decode("latin-1")
        if text.lower().startswith("file:") and text.split(" ")[-1].isdigit():
            offset = int(text.split(" ")[-1])
        if text.lower().startswith("datatype:") and not text.endswith("Float32LE"):
            raise ValueError(f"tck-datatype: {text}")
        if "END" in text:
            break
    else:
        raise ValueError("tck-header: no END")
    if offset is None:
        raise ValueError("tck-offset")
    return offset


def trk_spans(f: pa.NativeFile, size: int) -> Iterator[tuple[int, int]]:
    """Spans of whole streamlines, from the lengths before them."""
    scalars, properties, _ = trk_header(f.read(TRK_HEAD))
    at = begin = TRK_HEAD
    end = f.size()
    if at >= end:
        raise ValueError("trk-no-streamlines")
    while at < end:
        f.seek(at)
        raw = f.read(4)
        if len(raw) < 4:
            raise ValueError("trk-truncated: point count")
        n = struct.unpack("<i", raw)[0]
        if not 0 <= n <= MOST_POINTS:
            raise ValueError(f"trk-points: {n}")
        at += 4 + n * (12 + 4 * scalars) + 4 * properties
        if at > end:
            raise ValueError("trk-truncated: streamline")
        if at - begin >= size:
            yield begin, at
            begin = at
    if begin < at:
        yield begin, at


def spans(spark: SparkSession, path: str, size: int = SPAN_BYTES) -> DataFrame:
    """path, kind, begin, stop: the spans of every file under path; only headers and lengths are read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    parts = max(1, spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                f = opened(name)
                head = f.read(TRK_HEAD)
                if len(head) < 20:
                    raise ValueError(f"tract-too-small: {len(head)}")
                f.seek(0)
                if TCK_MARK in head[:64]:
                    begin, end, step = tck_offset(f.read(1 << 16)), f.size(), size // 12 * 12
                    if begin >= end:
                        raise ValueError("tck-offset")
                    found = [("tck", a, min(a + step, end)) for a in range(begin, end, step)]
                else:
                    found = [("trk", a, b) for a, b in trk_spans(f, size)]
                kinds, begins, stops = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(kinds), pa.array(begins, pa.int64()), pa.array(stops, pa.int64())], names=SPAN.names)

    return files.repartition(parts).mapInArrow(run, SPAN)


def _tck_lines(f: pa.NativeFile, begin: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, points) of the streamlines that begin in a span, read on to the end of the last one."""
    f.seek(0)
    start, size = tck_offset(f.read(1 << 16)), f.size()
    begin -= 12 * (begin > start)  # the mark before the span, if one is there, lets its first triplet begin a streamline
    f.seek(begin)
    rows = np.frombuffer(f.read(stop - begin), np.uint8)
    rows = rows[: len(rows) // 12 * 12].view("<f4").reshape(-1, 3)
    cuts = np.flatnonzero(~np.isfinite(rows[:, 0]))
    at = begin
    if begin > start:
        if not len(cuts):
            return
        at, rows, cuts = begin + 12 * (cuts[0] + 1), rows[cuts[0] + 1 :], cuts[1:] - cuts[0] - 1
    while True:
        for k, cut in enumerate(cuts):
            first = cuts[k - 1] + 1 if k else 0
            place = at + 12 * first
            if place >= stop:
                return
            yield int(place), rows[first:cut]
            if np.isinf(rows[cut, 0]):
                return
        done = int(cuts[-1]) + 1 if len(cuts) else 0
        rows, at = rows[done:], at + 12 * done
        if at >= stop:
            return
        more = np.frombuffer(f.read(1 << 16), np.uint8)
        more = more[: len(more) // 12 * 12].view("<f4").reshape(-1, 3)
        if not len(more) or f.tell() > size:
            raise ValueError("tck-truncated")
        held = len(rows)
        rows = np.concatenate([rows, more])
        cuts = np.flatnonzero(~np.isfinite(rows[held:, 0])) + held


def _trk_lines(f: pa.NativeFile, begin: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, points in the world with their scalars)."""
    f.seek(0)
    scalars, properties, matrix = trk_header(f.read(TRK_HEAD))
    f.seek(begin)
    data, at = f.read(stop - begin), 0
    while at < len(data):
        n = struct.unpack_from("<i", data, at)[0]
        rows = np.frombuffer(data, "<f4", n * (3 + scalars), at + 4).reshape(n, 3 + scalars).astype(np.float64)
        if matrix is not None:
            rows[:, :3] = rows[:, :3] @ matrix[:3, :3].T + matrix[:3, 3]
        yield begin + at, rows
        at += 4 + rows.shape[0] * (12 + 4 * scalars) + 4 * properties


def points(spark: SparkSession, path: str, size: int = SPAN_BYTES) -> DataFrame:
    """POINT rows of every file under path: line is the streamline's place in its file, k counts along it."""
    read = {"tck": _tck_lines, "trk": _trk_lines}
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = spans(spark, path, size).repartition(parts, "path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                for place, rows in read[span["kind"]](opened(span["path"]), span["begin"], span["stop"]):
                    n = len(rows)
                    if n:
                        own = pa.array(rows[:, 3:].astype(np.float32).ravel()) if rows.shape[1] > 3 else pa.array([], pa.float32())
                        ends = pa.array(np.arange(n + 1, dtype=np.int32) * (rows.shape[1] - 3))
                        columns = [pa.array([span["path"]] * n), pa.array(np.full(n, place, np.int64)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(rows[:, c].astype(np.float64)) for c in range(3)), pa.ListArray.from_arrays(ends, own)]
                        yield pa.RecordBatch.from_arrays(columns, names=POINT.names)

    return spread.mapInArrow(run, POINT)


def tck_bytes(lines: list[list[tuple[float, float, float]]]) -> bytes:
    """A .tck file of these streamlines."""
    head = "mrtrix tracks\ndatatype: Float32LE\nfile: . {}\nEND\n"
    head = head.format(f"{len(head) + 1:03d}").encode()
    marks = [(np.nan,) * 3] * (len(lines) - 1) + [(np.inf,) * 3]
    return head + b"".join(np.array([*line, mark], "<f4").tobytes() for line, mark in zip(lines, marks, strict=True))


def trk_bytes(lines: list[list[tuple[float, ...]]], scalars: int = 0, matrix: np.ndarray | None = None) -> bytes:
    """A .trk file of these streamlines, each point with its scalars."""
    head = bytearray(TRK_HEAD)
    head[:4] = TRK_MARK
    struct.pack_into("<h", head, 36, scalars)
    struct.pack_into("<II", head, 992, 2, TRK_HEAD)
    if matrix is not None:
        head[440:504] = np.asarray(matrix, "<f4").tobytes()
    return bytes(head) + b"".join(struct.pack("<i", len(line)) + np.array(line, "<f4").tobytes() for line in lines)

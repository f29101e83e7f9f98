"""Files from rows: each row's bytes become a file in a folder that all executors share, written by the tasks."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..operators.graph import _shared, dealt
from .dicom import EXPLICIT, LONG_VR


def write(rows: DataFrame, name: str, content: Callable[[dict], bytes], what: str) -> str:
    """The folder (in the shared one) of a file per row, called by its column `name`, with the bytes that content makes of it.

    A task that runs again writes the same files again, whole: each is written beside its place and then moved there."""
    folder = f"{_shared(rows.sparkSession)}/{what}-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row[name]}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                beside = f"{root}/_{uuid.uuid4().hex}"  # readers pass over names that begin so
                with store.open_output_stream(beside, compression=None) as out:
                    out.write(content(row))
                store.move(beside, path)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    if not rows.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
    return folder


def write_lines(rows: DataFrame, name: str, line: str, what: str, head: str = "", tail: str = "") -> str:
    """The folder (in the shared one) of a text file for each value of the column `name`: head, a line for each of its rows, tail.

    A task sorts its rows by file, which may spill, and writes them in passing, so that a file may be larger than its memory."""
    folder = f"{_shared(rows.sparkSession)}/{what}-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        pairs = (p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for file, own in groupby(pairs, itemgetter(0)):
            beside = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(beside, compression=None, buffer_size=1 << 20) as out:
                out.write(head.encode())
                for _, one in own:
                    out.write(f"{one}\n".encode())
                out.write(tail.encode())
            store.move(beside, f"{root}/{file}")
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["n"])

    dealt(rows.select(name, line), name).sortWithinPartitions(name).mapInArrow(run, "n long").agg({"n": "sum"}).first()
    return folder


def element(group: int, number: int, kind: str, value: bytes | str | float) -> bytes:
    """A DICOM element in explicit little endian: text is padded, a number is written as its kind."""
    if isinstance(value, int | float):
        value = struct.pack({"US": "<H", "UL": "<I", "FD": "<d"}[kind], value)
    if isinstance(value, str):
        value = value.encode("latin-1")
    value += (b"\0" if kind in ("UI", "OB") else b" ") * (len(value) % 2)
    if kind.encode() in LONG_VR:
        return struct.pack("<HH2sHI", group, number, kind.encode(), 0, len(value)) + value
    return struct.pack("<HH2sH", group, number, kind.encode(), len(value)) + value


def sequence(group: int, number: int, *items: bytes) -> bytes:
    """A sequence of items, each given as its elements."""
    body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items)
    return struct.pack("<HH2sHI", group, number, b"SQ", 0, len(body)) + body


def dicom_file(*parts: bytes, syntax: str = EXPLICIT) -> bytes:
    """A DICOM file of these elements."""
    meta = element(2, 0x10, "UI", syntax)
    return b"\0" * 128 + b"DICM" + element(2, 0, "UL", len(meta)) + meta + b"".join(parts)


def encapsulated(frames: list[bytes]) -> bytes:
    """Compressed pixels of these frames, with an offset table where there are several."""
    item = lambda b: struct.pack("<HHI", 0xFFFE, 0xE000, len(b)) + b
    frames = [f + b"\0" * (len(f) % 2) for f in frames]
    starts = [sum(8 + len(f) for f in frames[:k]) for k in range(len(frames))]
    table = struct.pack(f"<{len(starts)}I", *starts) if len(frames) > 1 else b""
    return struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + item(table) + b"".join(map(item, frames)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)

"""Compressed DICOM frames: run lengths, JPEG baseline and JPEG lossless, decoded frame by frame.

A file is read once into its header and its frames' bytes; frames then spread over tasks by a shuffle, whatever the number of
files, and each decodes alone.  Entropy codes are looked up sixteen bits at a time; everything after them is arithmetic over all
blocks or rows of a frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import dicom

#: Transfer syntaxes of DICOM.
RLE = "1.2.840.10008.1.2.5"
JPEG_BASELINE, JPEG_EXTENDED = "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51"
JPEG_LOSSLESS = ("1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70")
SYNTAXES = (RLE, JPEG_BASELINE, JPEG_EXTENDED, *JPEG_LOSSLESS)


def fragments(data: bytes, at: int) -> tuple[list[int], list[bytes], int]:
    """(offset table, fragments, the place after them) of encapsulated pixels whose first item begins at `at`."""
    items = []
    while True:
        if at + 8 > len(data):
            raise ValueError("dicom-truncated: no delimiter after the fragments")
        group, element, n = struct.unpack_from("<HHI", data, at)
        at += 8
        if (group, element) == (0xFFFE, 0xE0DD):
            if n:
                raise ValueError("dicom-bad-delimiter")
            break
        if (group, element) != (0xFFFE, 0xE000):
            raise ValueError(f"dicom-bad-item-tag: {group:04x}{element:04x}")
        if at + n > len(data):
            raise ValueError("dicom-truncated: a fragment ends beyond the file")
        items.append(data[at : at + n])
        at += n
    if not items:
        raise ValueError("dicom-empty: no offset table")
    table = items[0]
    return list(struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])), items[1:], at


def split_frames(table: list[int], parts: list[bytes], n_frames: int, syntax: str) -> list[bytes]:
    """Each frame's bytes: by the offset table where it has an entry per frame, else a JPEG frame begins at each start marker
    and a run-length frame is a fragment."""
    if len(table) == n_frames > 1:
        ends, at, frames = {}, 0, [b""] * n_frames
        for k, offset in enumerate(table):
            ends[offset] = k
        now = None
        for p in parts:
            now = ends.get(at, now)
            if now is None:
                raise ValueError("dicom-offset-table: no frame begins at the first fragment")
            frames[now] += p
            at += 8 + len(p)
        return frames
    if n_frames == 1:
        joined = b"".join(parts)
        if syntax != RLE and joined[:2] != b"\xff\xd8":
            raise ValueError("dicom-missing-soi")
        return [joined]
    if syntax == RLE:
        frames = list(parts)
    else:
        frames = []
        for p in parts:
            if p[:2] == b"\xff\xd8":
                frames.append(p)
            elif not frames:
                raise ValueError("dicom-missing-soi")
            else:
                frames[-1] += p
    if len(frames) != n_frames:
        raise ValueError(f"dicom-frame-count: {len(frames)} of {n_frames}")
    return frames


def decode_rle(frame: bytes, n_pixels: int, width: int) -> np.ndarray:
    """Little-endian pixels of width bytes from a run-length frame: a segment for each byte, the highest first."""
    if len(frame) < 64:
        raise ValueError("rle-short-header")
    n, *starts = struct.unpack_from("<16I", frame)
    if n != width:
        raise ValueError(f"rle-segment-count: {n} for {width}")
    starts = starts[:n]
    if any(s < 64 or s > len(frame) for s in starts) or sorted(starts) != starts:
        raise ValueError("rle-bad-offset")
    out = np.zeros((n_pixels, width), np.uint8)
    for k, at in enumerate(starts):
        plane = bytearray()
        while len(plane) < n_pixels:
            if at >= len(frame):
                raise ValueError("rle-truncated")
            code = frame[at]
            if code == 128:
                raise ValueError("rle-bad-code")
            if code < 128:
                part, at = frame[at + 1 : at + 2 + code], at + 2 + code
                if len(part) != code + 1 or len(plane) + len(part) > n_pixels:
                    raise ValueError("rle-literal-overrun")
                plane += part
            else:
                part, at = frame[at + 1 : at + 2], at + 2
                if not part or len(plane) + 257 - code > n_pixels:
                    raise ValueError("rle-run-overrun")
                plane += part * (257 - code)
        out[:, width - 1 - k] = np.frombuffer(bytes(plane), np.uint8)
    return out.view(f"<u{width}")[:, 0]


def encode_rle(values: np.ndarray) -> bytes:
    """The run-length frame of unsigned little-endian values: runs of two equal bytes and more, all else as it is."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    planes = [_packed(raw[:, k].tobytes()) for k in reversed(range(raw.shape[1]))]
    starts = [64 + sum(map(len, planes[:k])) for k in range(len(planes))]
    return struct.pack("<16I", len(planes), *starts, *[0] * (15 - len(planes))) + b"".join(planes)


def _packed(plane: bytes) -> bytes:
    out, at = bytearray(), 0
    edges = [*(np.flatnonzero(np.diff(np.frombuffer(plane, np.uint8))) + 1).tolist(), len(plane)] if plane else []
    waiting = b""
    for end in edges:
        while end - at > 1:  # a run
            n = min(128, end - at)
            out += _literal(waiting) + (bytes([257 - n, plane[at]]) if n > 1 else b"")
            waiting, at = b"", at + n
        if end > at:
            waiting, at = waiting + plane[at:end], end
    return bytes(out + _literal(waiting))


def _literal(part: bytes) -> bytes:
    return b"".join(bytes([len(part[k : k + 128]) - 1]) + part[k : k + 128] for k in range(0, len(part), 128))


def _zigzag() -> np.ndarray:
    """Places in a block of 64, by the order of the code: along diagonals, in turn upwards and downwards."""
    places = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in places])


ZIGZAG = _zigzag()
#: Cosines of the transform: BASIS[x, u] of sample x and frequency u.
BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
MARKERS = {0xC0, 0xC1, 0xC3}


class Bits:
    """A scan's bits after taking out stuffed bytes, cut at restart markers: sixteen from any place in one look."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.uint64)
        self.window = ((raw[:-3] << np.uint64(24)) | (raw[1:-2] << np.uint64(16)) | (raw[2:-1] << np.uint64(8)) | raw[3:]).tolist()
        self.at, self.end = 0, 8 * (len(raw) - 8)

    def look(self) -> int:
        return self.window[self.at >> 3] >> 16 - (self.at & 7) & 0xFFFF

    def take(self, n: int) -> int:
        """A signed number of n bits: those that begin with 0 are negative."""
        if not n:
            return 0
        if n > 16 or self.at + n > self.end:
            raise ValueError("jpeg-truncated")
        found = self.look() >> 16 - n
        self.at += n
        return found if found >> n - 1 else found - (1 << n) + 1


class Code:
    """A prefix code: for each sixteen bits, what they begin with and how long that is."""

    def __init__(self, counts: bytes, values: bytes):
        if sum(counts) != len(values) or sum(c << 15 - k for k, c in enumerate(counts)) > 1 << 16:
            raise ValueError("jpeg-bad-table")
        symbol, length, at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        place = 0
        for k, c in enumerate(counts):
            for _ in range(c):
                span = 1 << 15 - k
                symbol[place : place + span], length[place : place + span] = values[at], k + 1
                place += span
                at += 1
        self.symbol, self.length = symbol.tolist(), length.tolist()

    def next(self, bits: Bits) -> int:
        if bits.at >= bits.end:
            raise ValueError("jpeg-truncated")
        found = bits.look()
        n = self.length[found]
        if not n:
            raise ValueError("jpeg-bad-huffman")
        bits.at += n
        return self.symbol[found]


class Jpeg:
    """The segments of a frame up to its scan, and the scan's stretches between restart markers."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("jpeg-no-soi")
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], Code] = {}
        self.restart, self.kind, self.scan = 0, None, None
        at = 2
        while self.scan is None:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("jpeg-truncated")
            kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if n < 2 or len(body) != n - 2:
                raise ValueError("jpeg-truncated")
            if kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._codes(body)
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif kind in MARKERS:
                if self.kind is not None:
                    raise ValueError("jpeg-multi-frame")
                self._frame(kind, body)
            elif kind == 0xC2:
                raise ValueError("jpeg-progressive")
            elif 0xC3 < kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("jpeg-unsupported-sof")
            elif kind == 0xDA:
                self._scan(body, data, at)

    def _quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            if wide > 1:
                raise ValueError("jpeg-bad-dqt")
            size = 64 * (1 + wide)
            if len(body) < 1 + size:
                raise ValueError("jpeg-truncated")
            table = np.zeros(64)
            table[ZIGZAG] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1")
            self.quant[body[0] & 15] = table
            body = body[1 + size :]

    def _codes(self, body: bytes) -> None:
        while body:
            counts = body[1:17]
            n = sum(counts)
            if len(counts) < 16 or len(body) < 17 + n:
                raise ValueError("jpeg-truncated")
            self.codes[body[0] >> 4, body[0] & 15] = Code(counts, body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, kind: int, body: bytes) -> None:
        self.kind = kind
        self.precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if n not in (1, 3):
            raise ValueError(f"jpeg-bad-components: {n}")
        self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]

    def _scan(self, body: bytes, data: bytes, at: int) -> None:
        if self.kind is None:
            raise ValueError("jpeg-no-sof")
        self.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
        self.spectral, self.shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
        if set(self.tables) != {p[0] for p in self.parts}:
            raise ValueError("jpeg-several-scans")
        self.scan, begin = [], at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                self.scan.append(data[begin:])
                return
            mark = data[at + 1]
            if mark and mark != 0xFF:
                self.scan.append(data[begin:at])
                if not 0xD0 <= mark <= 0xD7:
                    return
                begin = at + 2
            at += 2 if mark != 0xFF else 1

    def code(self, kind: int, number: int) -> Code:
        if (kind, number) not in self.codes:
            raise ValueError("jpeg-missing-table")
        return self.codes[kind, number]


def _coefficients(jpeg: Jpeg) -> list[np.ndarray]:
    """Of each component, [block row, block column, 64] in natural order, as coded."""
    widest, tallest = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)
    across, down = -(-jpeg.width // (8 * widest)), -(-jpeg.height // (8 * tallest))
    out, turns = [], []
    if len(jpeg.parts) == 1:
        rows, cols = -(-jpeg.height // 8), -(-jpeg.width // 8)
        out.append(np.zeros((rows, cols, 64)))
        turns = [[(0, k // cols, k % cols)] for k in range(rows * cols)]
    else:
        for _, h, v, _ in jpeg.parts:
            out.append(np.zeros((down * v, across * h, 64)))
        for m in range(across * down):
            y, x = divmod(m, across)
            turns.append([(c, y * v + j, x * h + i) for c, (_, h, v, _) in enumerate(jpeg.parts) for j in range(v) for i in range(h)])
    codes = [(jpeg.code(0, jpeg.tables[p[0]][0]), jpeg.code(1, jpeg.tables[p[0]][1])) for p in jpeg.parts]
    order = ZIGZAG.tolist()
    every = jpeg.restart or len(turns)
    for k, begin in enumerate(range(0, len(turns), every)):
        if k >= len(jpeg.scan):
            raise ValueError("jpeg-truncated")
        bits, last = Bits(jpeg.scan[k]), [0] * len(jpeg.parts)
        for turn in turns[begin : begin + every]:
            for c, y, x in turn:
                direct, rest = codes[c]
                last[c] += bits.take(direct.next(bits))
                block = out[c][y, x]
                block[0] = last[c]
                at = 1
                while at < 64:
                    run, size = divmod(rest.next(bits), 16)
                    if not size:
                        if run < 15:
                            break
                        at += 16
                        continue
                    at += run
                    if at > 63:
                        raise ValueError("jpeg-bad-block")
                    block[order[at]] = bits.take(size)
                    at += 1
    return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """(height, width) grey values of a baseline frame; of three components the luma of its colours."""
    jpeg = Jpeg(data)
    if jpeg.kind == 0xC3:
        raise ValueError("jpeg-unsupported-sof")
    if jpeg.precision != 8:
        raise ValueError(f"jpeg-bad-precision: {jpeg.precision}")
    planes = []
    for (_, h, v, q), blocks in zip(jpeg.parts, _coefficients(jpeg), strict=True):
        if q not in jpeg.quant:
            raise ValueError("jpeg-missing-table")
        square = (blocks * jpeg.quant[q]).reshape(*blocks.shape[:2], 8, 8)
        samples = BASIS @ square @ BASIS.T + 128
        flat = np.clip(np.rint(samples), 0, 255).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
        widest, tallest = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)
        y, x = np.arange(jpeg.height) * v // tallest, np.arange(jpeg.width) * h // widest
        planes.append(flat[y][:, x])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    r, g, b = (np.clip(c, 0, 255).astype(np.uint8) for c in (y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def decode_lossless(data: bytes) -> np.ndarray:
    """(height, width) values of a lossless frame of one component: differences to a prediction from left, above, above left."""
    jpeg = Jpeg(data)
    if jpeg.kind != 0xC3:
        raise ValueError("jpeg-unsupported-sof")
    if len(jpeg.parts) != 1:
        raise ValueError(f"jpeg-bad-components: {len(jpeg.parts)}")
    if not 1 <= jpeg.spectral <= 7:
        raise ValueError("jpeg-bad-predictor")
    code, width = jpeg.code(0, jpeg.tables[jpeg.parts[0][0]][0]), jpeg.width
    if jpeg.restart % width:
        raise ValueError("jpeg-bad-restart")
    out = np.zeros((jpeg.height, width), np.int64)
    rows_each = (jpeg.restart // width) or jpeg.height
    first = 1 << jpeg.precision - jpeg.shift - 1
    for k, begin in enumerate(range(0, jpeg.height, rows_each)):
        if k >= len(jpeg.scan):
            raise ValueError("jpeg-truncated")
        bits = Bits(jpeg.scan[k])
        for y in range(begin, min(begin + rows_each, jpeg.height)):
            change = []
            for _ in range(width):
                size = code.next(bits)
                if size > 16:
                    raise ValueError("jpeg-bad-huffman")
                change.append(32768 if size == 16 else bits.take(size))
            out[y] = _row(change, out[y - 1] if y > begin else None, first, jpeg.spectral)
    return (out << jpeg.shift).astype(np.uint16)


def _row(change: list[int], above: np.ndarray | None, first: int, predictor: int) -> np.ndarray:
    low = 0xFFFF
    if above is None:
        return (first + np.cumsum(change)) & low
    d, b = np.array(change), above
    if predictor == 2:
        out = b + d
    elif predictor == 3:
        out = np.concatenate([b[:1], b[:-1]]) + d
    elif predictor == 1:
        out = np.concatenate([[b[0] + d[0]], d[1:]]).cumsum()
    elif predictor == 4:
        out = np.concatenate([[b[0] + d[0]], np.diff(b) + d[1:]]).cumsum()
    else:
        a, out = int(b[0]) + change[0] & low, [int(b[0]) + change[0]]
        for x, (now, before) in enumerate(zip(b[1:].tolist(), b[:-1].tolist(), strict=True), 1):
            guess = a + (now - before >> 1) if predictor == 5 else now + (a - before >> 1) if predictor == 6 else a + now >> 1
            a = guess + change[x] & low
            out.append(a)
        return np.array(out) & low
    out = out.copy()
    out[0] = b[0] + d[0]
    return out & low


def decode(frame: bytes, syntax: str, rows: int, cols: int, bits: int, signed: bool) -> np.ndarray:
    """rows * cols stored values of one frame."""
    if syntax == RLE:
        found = decode_rle(frame, rows * cols, bits // 8)
    else:
        image = decode_lossless(frame) if syntax in JPEG_LOSSLESS else decode_jpeg(frame)
        if image.shape != (rows, cols):
            raise ValueError(f"jpeg-dims: {image.shape[1]}x{image.shape[0]} for {cols}x{rows}")
        found = image.ravel()
    return found.astype(f"<u{bits // 8}").view(f"<i{bits // 8}") if signed else found


HEADER = T.StructType([f for f in dicom.FRAME if f.name != "pixels"] + [T.StructField("syntax", T.StringType()), T.StructField("bits", T.IntegerType()), T.StructField("signed", T.BooleanType()), T.StructField("frame", T.BinaryType())])


def coded_frames(spark: SparkSession, path: str) -> DataFrame:
    """Every frame of the compressed files under path as it is stored, with its file's header."""
    schema = pa.schema([pa.field(f.name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]) for f in HEADER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                head, parts = encapsulated(batch.column(1)[k].as_py())
                for n, part in enumerate(parts):
                    row = head | {"path": batch.column(0)[k].as_py(), "frame_index": n, "frame": part}
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, HEADER)


def encapsulated(data: bytes) -> tuple[dict, list[bytes]]:
    """(header values, each frame's bytes) of one file."""
    syntax, body = dicom.body_of(data)
    if syntax not in SYNTAXES:
        raise ValueError(f"transfer-syntax: {syntax or 'none'}")
    found, at = dicom.values_before_pixels(body)
    head = dicom.header_of(found)
    if at is None:
        raise ValueError("dicom-no-pixels")
    if head["samples"] != 1 and syntax == RLE:
        raise ValueError(f"rle-samples: {head['samples']}")
    table, parts, _ = fragments(body, at)
    return head | {"syntax": syntax}, split_frames(table, parts, head["n_frames"], syntax)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAME rows (as of dicom.frames) of the compressed files under path."""
    coded = coded_frames(spark, path)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = coded.repartition(parts, "path", "frame_index")
    rest = [f.name for f in dicom.FRAME if f.name != "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("frame", "syntax", "rows", "cols", "bits", "signed", "slope", "intercept")}
                values = decode(one["frame"], one["syntax"], one["rows"], one["cols"], one["bits"], one["signed"]) * one["slope"] + one["intercept"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in rest), pa.array([values], pa.list_(pa.float64()))], names=[*rest, "pixels"])

    return spread.mapInArrow(run, dicom.FRAME)

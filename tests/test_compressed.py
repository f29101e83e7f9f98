"""Compressed frames against encoders of this file."""

import struct

import numpy as np
import pytest
from test_images import element

from morpholake.sources import dicom, dicom_compressed as codec


def rle_plane(plane):
    out, at = b"", 0
    while at < len(plane):
        run = 1
        while at + run < len(plane) and run < 128 and plane[at + run] == plane[at]:
            run += 1
        if run > 1:
            out, at = out + bytes([257 - run, plane[at]]), at + run
            continue
        stop = at + 1
        while stop < len(plane) and stop - at < 128 and (stop + 1 >= len(plane) or plane[stop] != plane[stop + 1]):
            stop += 1
        out, at = out + bytes([stop - at - 1]) + plane[at:stop], stop
    return out


def rle_frame(pixels):
    raw = pixels.view(np.uint8).reshape(len(pixels), -1)
    planes = [rle_plane(raw[:, k].tobytes()) for k in reversed(range(raw.shape[1]))]
    starts = [64 + sum(map(len, planes[:k])) for k in range(len(planes))]
    return struct.pack("<16I", len(planes), *starts, *[0] * (15 - len(planes))) + b"".join(planes)


class Writer:
    def __init__(self):
        self.text = ""

    def symbol(self, s):
        self.text += f"{s:08b}"  # every symbol has a code of eight bits: its place in the table

    def number(self, v, size):
        if size:
            self.text += f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def table(kind, number, symbols):
    return segment(0xC4, bytes([kind << 4 | number]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))


DIRECT, REST = list(range(17)), [r << 4 | s for r in range(16) for s in range(1, 16) if r << 4 | s < 0xFF][:230] + [0, 0xF0]


def put_block(w, block, last):
    size = int(abs(block[0] - last)).bit_length()
    w.symbol(DIRECT.index(size))
    w.number(int(block[0] - last), size)
    run = 0
    for v in block[codec.ZIGZAG][1:]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            w.symbol(REST.index(0xF0))
            run -= 16
        size = int(abs(v)).bit_length()
        w.symbol(REST.index(run << 4 | size))
        w.number(int(v), size)
        run = 0
    if run:
        w.symbol(REST.index(0))


def jpeg(planes, sampling, shape, quant=3, restart=0):
    """A baseline JPEG of planes whose sizes are whole numbers of blocks."""
    height, width = shape
    n = len(planes)
    head = segment(0xDB, bytes([0] + [quant] * 64)) + table(0, 0, DIRECT) + table(1, 0, REST)
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    head += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    blocks = []
    for p in planes:
        square = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128.0
        blocks.append(np.rint(codec.BASIS.T @ square @ codec.BASIS / quant).reshape(*square.shape[:2], 64).astype(int))
    h0, v0 = sampling[0]
    turns = [(y, x) for y in range(blocks[0].shape[0] // v0) for x in range(blocks[0].shape[1] // h0)]
    scan, w, last = b"", Writer(), [0] * n
    for k, (y, x) in enumerate(turns):
        if restart and k and k % restart == 0:
            scan += w.bytes() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
            w, last = Writer(), [0] * n
        for c, (h, v) in enumerate(sampling):
            for j in range(v):
                for i in range(h):
                    block = blocks[c][y * v + j, x * h + i]
                    put_block(w, block, last[c])
                    last[c] = block[0]
    return b"\xff\xd8" + head + segment(0xDA, bytes([n]) + b"".join(bytes([k, 0]) for k in range(n)) + b"\0\x3f\0") + scan + w.bytes() + b"\xff\xd9"


def lossless(pixels, precision, predictor, shift=0, restart=0):
    height, width = pixels.shape
    p = pixels.astype(int) >> shift
    scan, w = b"", Writer()
    for y in range(height):
        first = y == 0 or restart and y % restart == 0
        if y and restart and y % restart == 0:
            scan, w = scan + w.bytes() + bytes([0xFF, 0xD0 + (y // restart - 1) % 8]), Writer()
        for x in range(width):
            a, b, c = (p[y, x - 1] if x else 0), (p[y - 1, x] if y else 0), (p[y - 1, x - 1] if x and y else 0)
            if first:
                guess = 1 << precision - shift - 1 if x == 0 else a
            elif x == 0:
                guess = b
            else:
                guess = (a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor - 1]
            d = (int(p[y, x]) - int(guess) + 32767) % 65536 - 32767
            size = abs(d).bit_length()
            w.symbol(size)
            w.number(d, size if size < 16 else 0)
    head = table(0, 0, DIRECT) + segment(0xC3, struct.pack(">BHHB", precision, height, width, 1) + bytes([0, 0x11, 0]))
    head += segment(0xDD, struct.pack(">H", restart * width)) if restart else b""
    return b"\xff\xd8" + head + segment(0xDA, bytes([1, 0, 0, predictor, 0, shift])) + scan + w.bytes() + b"\xff\xd9"


def compressed_file(syntax, parts, rows, cols, bits, n_frames=1, table=(), signed=0):
    item = lambda b: struct.pack("<HHI", 0xFFFE, 0xE000, len(b)) + b
    pixels = struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + item(struct.pack(f"<{len(table)}I", *table)) + b"".join(map(item, parts)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    short = lambda e, v: element(0x28, e, "US", struct.pack("<H", v))
    body = element(0x20, 0xE, "UI", b"1.2.3") + element(0x28, 8, "IS", str(n_frames).encode()) + short(0x10, rows) + short(0x11, cols) + short(0x100, bits) + short(0x103, signed) + element(0x28, 0x1052, "DS", b"-5 ") + element(0x28, 0x1053, "DS", b"2 ")
    meta = element(2, 0x10, "UI", syntax.encode())
    return b"\0" * 128 + b"DICM" + element(2, 0, "UL", struct.pack("<I", len(meta))) + meta + body + pixels


@pytest.mark.parametrize("kind", ["u1", "<u2"])
def test_run_lengths(kind):
    random = np.random.default_rng(1)
    pixels = np.repeat(random.integers(0, 1 << 8 * np.dtype(kind).itemsize, 150), random.integers(1, 300, 150)).astype(kind)
    assert (codec.decode_rle(rle_frame(pixels), len(pixels), pixels.itemsize) == pixels).all()


def test_run_length_errors():
    good = rle_frame(np.arange(40, dtype="u1"))
    for bad, name in ((good[:30], "short-header"), (struct.pack("<I", 2) + good[4:], "segment-count"), (good[:4] + struct.pack("<I", 20) + good[8:], "bad-offset"), (good[:-5], "literal-overrun"), (good[:64], "truncated"), (good[:64] + b"\x80", "bad-code"), (good[:64] + b"\x90", "run-overrun")):
        with pytest.raises(ValueError, match=f"rle-{name}"):
            codec.decode_rle(bad, 40, 1)


def smooth(height, width, seed):
    y, x = np.mgrid[:height, :width]
    return np.clip(128 + 90 * np.sin(x / 9 + seed) * np.cos(y / 7) + np.random.default_rng(seed).normal(0, 3, (height, width)), 0, 255)


@pytest.mark.parametrize("restart", [0, 3])
def test_grey_jpeg(restart):
    image = smooth(24, 40, 1)
    found = codec.decode_jpeg(jpeg([image], [(1, 1)], (21, 37), restart=restart))
    assert found.shape == (21, 37) and abs(found.astype(int) - image[:21, :37]).max() <= 8


def test_colour_jpeg_with_coarse_colours():
    luma, blue, red = smooth(32, 32, 2), np.full((16, 16), 150.0), np.full((16, 16), 110.0)
    found = codec.decode_jpeg(jpeg([luma, blue, red], [(2, 2), (1, 1), (1, 1)], (32, 32)))
    assert abs(found.astype(int) - luma).mean() < 3


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg(predictor):
    random = np.random.default_rng(predictor)
    for precision, restart in ((8, 0), (16, 0), (16, 2), (12, 3)):
        pixels = random.integers(0, 1 << precision, (7, 11))
        assert (codec.decode_lossless(lossless(pixels, precision, predictor, restart=restart)) == pixels).all()
    assert (codec.decode_lossless(lossless(pixels, 12, predictor, shift=2)) == pixels >> 2 << 2).all()


def test_jpeg_errors():
    good = jpeg([smooth(16, 16, 3)], [(1, 1)], (16, 16))
    for bad, name in ((b"abc", "no-soi"), (good.replace(b"\xff\xc0", b"\xff\xc2"), "progressive"), (good.replace(b"\xff\xc0", b"\xff\xc5"), "unsupported-sof"), (good[:-60], "truncated"), (good[:30], "truncated"), (good.replace(b"\xff\xdb", b"\xff\xe3"), "missing-table")):
        with pytest.raises(ValueError, match=f"jpeg-{name}"):
            codec.decode_jpeg(bad)
    with pytest.raises(ValueError, match="unsupported-sof"):
        codec.decode_lossless(good)
    with pytest.raises(ValueError, match="bad-predictor"):
        codec.decode_lossless(lossless(np.ones((2, 2), int), 8, 1).replace(b"\x01\x00\x00\x01\x00\x00", b"\x01\x00\x00\x00\x00\x00"))


def test_frames_of_files(spark, tmp_path):
    random = np.random.default_rng(4)
    whole = random.integers(-300, 300, (3, 5, 6)).astype("<i2")
    rle = [rle_frame(p.ravel().view("<u2")) for p in whole]
    (tmp_path / "rle.dcm").write_bytes(compressed_file(codec.RLE, rle, 5, 6, 16, 3, signed=1))
    grey = jpeg([smooth(16, 16, 5)], [(1, 1)], (16, 16))
    cut = [grey[:50], grey[50:], grey]
    table = [0, len(cut[0]) + len(cut[1]) + 16]
    for name, offsets in (("table", table), ("plain", ())):
        (tmp_path / f"{name}.dcm").write_bytes(compressed_file(codec.JPEG_BASELINE, cut, 16, 16, 8, 2, offsets))
    exact = random.integers(0, 65536, (4, 4))
    (tmp_path / "exact.dcm").write_bytes(compressed_file(codec.JPEG_LOSSLESS[1], [lossless(exact, 16, 1)], 4, 4, 16))
    rows = {(r["path"].rsplit("/", 1)[1], r["frame_index"]): r for r in codec.frames(spark, str(tmp_path)).collect()}
    assert len(rows) == 8
    for k in range(3):
        assert rows["rle.dcm", k]["pixels"] == (whole[k].ravel() * 2.0 - 5).tolist()
    once = (codec.decode_jpeg(grey).ravel() * 2.0 - 5).tolist()
    assert all(rows[f"{n}.dcm", k]["pixels"] == once for n in ("table", "plain") for k in (0, 1))
    assert rows["exact.dcm", 0]["pixels"] == (exact.ravel() * 2.0 - 5).tolist() and rows["exact.dcm", 0]["series_uid"] == "1.2.3"


def test_file_errors():
    grey = jpeg([smooth(16, 16, 5)], [(1, 1)], (16, 16))
    good = compressed_file(codec.JPEG_BASELINE, [grey], 16, 16, 8)
    for bad, name in ((good[:-8], "truncated"), (good[:-8] + struct.pack("<HHI", 0xFFFE, 0xE0DD, 4), "bad-delimiter"), (good[:-8] + struct.pack("<HHI", 0xFFFE, 0xE00D, 0), "bad-item-tag"), (compressed_file(dicom.EXPLICIT, [grey], 16, 16, 8), "transfer-syntax"), (compressed_file(codec.JPEG_BASELINE, [grey[2:]], 16, 16, 8), "missing-soi"), (compressed_file(codec.JPEG_BASELINE, [grey], 16, 16, 8, 2), "frame-count")):
        with pytest.raises(ValueError, match=name):
            codec.encapsulated(bad)
    with pytest.raises(ValueError, match="jpeg-dims"):
        codec.decode(grey, codec.JPEG_BASELINE, 8, 8, 8, False)

import gzip

import numpy as np
import pyarrow as pa
import pytest

from morpholake.sources import tracts

LINES = [[(float(a), float(b), float(a * b)) for b in range(1 + a * 7 % 5)] for a in range(40)]


def lines_of(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["line"], r["k"])):
        found.setdefault(r["line"], []).append((r["x"], r["y"], r["z"]))
    return list(found.values())


@pytest.mark.parametrize("size", [24, 36, 500, 10**6])
def test_tck(spark, tmp_path, size):
    (tmp_path / "a.tck").write_bytes(tracts.tck_bytes(LINES))
    assert lines_of(tracts.points(spark, str(tmp_path), size).collect()) == LINES


@pytest.mark.parametrize("size", [1, 300, 10**6])
def test_trk(spark, tmp_path, size):
    matrix = np.diag([2.0, 1, 1, 1])
    matrix[:3, 3] = 5, 0, -1
    with_scalar = [[(*p, p[0] / 2) for p in line] for line in LINES]
    (tmp_path / "a.trk").write_bytes(tracts.trk_bytes(with_scalar, 1, matrix))
    rows = tracts.points(spark, str(tmp_path), size).collect()
    assert lines_of(rows) == [[(2 * x + 5, y, z - 1) for x, y, z in line] for line in LINES]
    assert all(r["scalars"] == [(r["x"] - 5) / 4] for r in rows)


def test_compressed_trk_without_matrix(spark, tmp_path):
    (tmp_path / "a.trk.gz").write_bytes(gzip.compress(tracts.trk_bytes(LINES)))
    assert lines_of(tracts.points(spark, str(tmp_path)).collect()) == LINES


def read(data, size=10**6):
    f = pa.BufferReader(data)
    return list(tracts.trk_spans(f, size))


def test_errors():
    good = tracts.trk_bytes(LINES)
    assert read(good)[0][0] == tracts.TRK_HEAD and read(good)[-1][1] == len(good)
    bad_size, bad_count = bytearray(good), bytearray(good)
    bad_size[996] = 1
    bad_count[1000:1004] = b"\xff\xff\xff\xff"
    for data, name in ((good[:500], "too-small"), (b"XXXX" + good[4:], "magic"), (bytes(bad_size), "version"), (bytes(bad_count), "points"), (good[:-5], "truncated"), (good[:1000], "no-streamlines")):
        with pytest.raises(ValueError, match=f"trk-{name}"):
            read(data)
    tck = tracts.tck_bytes(LINES)
    for data, name in ((b"nothing here\nEND\n", "signature"), (tck.replace(b"Float32LE", b"Float32BE"), "datatype"), (tck.replace(b"END", b"---"), "header"), (tck.replace(b"file:", b"fill:"), "offset")):
        with pytest.raises(ValueError, match=f"tck-{name}"):
            tracts.tck_offset(data)
    with pytest.raises(ValueError, match="tck-truncated"):
        list(tracts._tck_lines(pa.BufferReader(tck[:-12]), tracts.tck_offset(tck), len(tck) - 12))

"""Queries over files that tasks write from the tables, and over operators of image stacks, paths and text documents."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, ordered, paths, quality, stacks, voxels
from ..sources import dicom, dicom_compressed, dicom_objects, dicomweb, files, reports, text, tiff, tracts, volumes, zarr
from .registry import query
from .source_queries import tabbed, written
from .tables import base, domain

S, D = SparkSession, DataFrame
E, SEQ = files.element, files.sequence


def _suppliers(spark: S, d: str) -> D:
    k = F.col("s_suppkey")
    return base(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("n"), F.concat(k.cast("string"), F.lit(".dat")).alias("file"))


def _frame(row: dict, frame: int) -> np.ndarray:
    """A picture of 4 rows and 5 columns for every supplier and frame."""
    y, x = np.mgrid[:4, :5]
    return (row["k"] % 200 * 3 + row["n"] * x + frame * 100 + y // 2).astype("<u2")


PICTURE = "SELECT s_suppkey AS k, f, x, y, s_suppkey % 200 * 3 + s_nationkey * x + f * 100 + y // 2 AS v FROM supplier, range(0, 2) AS a(f), range(0, 5) AS b(x), range(0, 4) AS c(y)"


def _header(row: dict, bits: int = 16, frames: int = 2) -> bytes:
    return b"".join([E(0x20, 0xE, "UI", f"1.2.{row['k']}"), E(0x28, 8, "IS", str(frames)), E(0x28, 0x10, "US", 4), E(0x28, 0x11, "US", 5), E(0x28, 0x100, "US", bits), E(0x28, 0x103, "US", 0), E(0x28, 0x1052, "DS", "-10"), E(0x28, 0x1053, "DS", "2")])


def _pixels(frames: D) -> D:
    i = F.col("i")
    long_ = frames.select(F.substring_index("series_uid", ".", -1).cast("bigint").alias("k"), F.col("frame_index").cast("bigint").alias("f"), F.posexplode("pixels").alias("i", "v"))
    return long_.select("k", "f", (i % 5).cast("bigint").alias("x"), F.floor(i / 5).alias("y"), F.col("v").cast("bigint").alias("v"))


@query(f"SELECT k, f, x, y, v * 2 - 10 AS v FROM ({PICTURE})")
def plain_frames(spark: S, d: str) -> D:
    content = lambda r: files.dicom_file(_header(r), E(0x7FE0, 0x10, "OW", b"".join(_frame(r, f).tobytes() for f in (0, 1))))
    return _pixels(dicom.frames(spark, files.write(_suppliers(spark, d), "file", content, "plain-frames")))


@query(f"SELECT k, f, x, y, v * 2 - 10 AS v FROM ({PICTURE})")
def run_length_frames(spark: S, d: str) -> D:
    content = lambda r: files.dicom_file(_header(r), files.encapsulated([dicom_compressed.encode_rle(_frame(r, f).ravel()) for f in (0, 1)]), syntax=dicom_compressed.RLE)
    return _pixels(dicom_compressed.frames(spark, files.write(_suppliers(spark, d), "file", content, "run-length-frames")))


def _flat_jpeg(grey: int) -> bytes:
    """An 8 x 8 baseline JPEG of one grey: a direct part in steps of the quantum, no other frequency."""
    quantum, value = 8, grey - 128  # the direct part of a block is 8 times its mean
    size = abs(value).bit_length()
    bits = f"{size:08b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "") + "00000000"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    table = lambda kind, symbols: segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    frame = segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([0, 0x11, 0]))
    return b"\xff\xd8" + segment(0xDB, bytes([0] + [quantum] * 64)) + table(0, range(12)) + table(1, [0]) + frame + segment(0xDA, bytes([1, 0, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@query("SELECT s_suppkey AS k, f, 64 AS n, (s_suppkey * 7 + f * 31) % 256 AS low, (s_suppkey * 7 + f * 31) % 256 AS high FROM supplier, range(0, 2) AS a(f)")
def jpeg_frames(spark: S, d: str) -> D:
    def content(r: dict) -> bytes:
        head = b"".join([E(0x20, 0xE, "UI", f"1.2.{r['k']}"), E(0x28, 8, "IS", "2"), E(0x28, 0x10, "US", 8), E(0x28, 0x11, "US", 8), E(0x28, 0x100, "US", 8)])
        return files.dicom_file(head, files.encapsulated([_flat_jpeg((r["k"] * 7 + f * 31) % 256) for f in (0, 1)]), syntax=dicom_compressed.JPEG_BASELINE)

    rows = dicom_compressed.frames(spark, files.write(_suppliers(spark, d), "file", content, "jpeg-frames"))
    return rows.select(F.substring_index("series_uid", ".", -1).cast("bigint").alias("k"), F.col("frame_index").cast("bigint").alias("f"), F.size("pixels").alias("n"), F.array_min("pixels").cast("bigint").alias("low"), F.array_max("pixels").cast("bigint").alias("high"))


@query("SELECT CAST(s_nationkey AS INT) AS roi, 'Part ' || s_suppkey AS name, o AS \"order\", CAST(s_suppkey % 50 + CASE WHEN o IN (1, 2) THEN 3 ELSE 0 END AS DOUBLE) AS x, CAST(CASE WHEN o >= 2 THEN 2.5 ELSE 0 END AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier, (SELECT CAST(unnest(range(0, 4)) AS INT) AS o)")
def contour_points(spark: S, d: str) -> D:
    def content(r: dict) -> bytes:
        x, z = r["k"] % 50, r["n"]
        square = "\\".join(f"{a}\\{b}\\{z}" for a, b in ((x, 0), (x + 3, 0), (x + 3, 2.5), (x, 2.5)))
        return files.dicom_file(SEQ(0x3006, 0x20, E(0x3006, 0x22, "IS", str(r["n"])) + E(0x3006, 0x26, "LO", f"Part {r['k']}")), SEQ(0x3006, 0x39, SEQ(0x3006, 0x40, E(0x3006, 0x42, "CS", "CLOSED_PLANAR") + E(0x3006, 0x50, "DS", square)) + E(0x3006, 0x84, "IS", str(r["n"]))))

    rows = dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "contours"), "contours")
    return rows.select("roi", "name", "order", "x", "y", "z")


@query("SELECT CAST(1 + f AS INT) AS segment, CASE WHEN f = 0 THEN 'Core ' || s_suppkey END AS label, CAST(f * 2.5 AS DOUBLE) AS z, CAST(i AS INT) AS i FROM supplier, range(0, 2) AS a(f), range(0, 12) AS b(i) WHERE (s_suppkey + i * (f + 1)) % 3 = 0")
def segment_pixels(spark: S, d: str) -> D:
    def content(r: dict) -> bytes:
        on = np.array([(r["k"] + i * (f + 1)) % 3 == 0 for f in (0, 1) for i in range(12)])
        frame = lambda f: SEQ(0x20, 0x9111, E(0x20, 0x9157, "UL", 1 + f)) + SEQ(0x20, 0x9113, E(0x20, 0x32, "DS", f"0\\0\\{f * 2.5}"))
        size = E(0x28, 0x10, "US", 3) + E(0x28, 0x11, "US", 4) + E(0x28, 0x100, "US", 1)
        return files.dicom_file(size, SEQ(0x62, 2, E(0x62, 4, "US", 1) + E(0x62, 5, "LO", f"Core {r['k']}")), SEQ(0x5200, 0x9230, frame(0), frame(1)), E(0x7FE0, 0x10, "OB", np.packbits(on, bitorder="little").tobytes()))

    rows = dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "segments"), "segments")
    return rows.select("segment", F.nullif(F.col("label"), F.lit("")).alias("label"), "z", "i")


@query("SELECT '1.' || s_nationkey AS study, '1.' || s_nationkey || '.' || s_suppkey AS series, CAST(f AS INT) AS instance_number, 'D' || s_suppkey || '/I' || f AS file_id FROM supplier, range(1, 4) AS a(f)")
def directory_images(spark: S, d: str) -> D:
    def content(r: dict) -> bytes:
        kind = lambda name, *more: E(4, 0x1430, "CS", name) + b"".join(more)
        images = [kind("IMAGE", E(4, 0x1500, "CS", f"D{r['k']}\\I{f}"), E(0x20, 0x13, "IS", str(f))) for f in (1, 2, 3)]
        return files.dicom_file(SEQ(4, 0x1220, kind("STUDY", E(0x20, 0xD, "UI", f"1.{r['n']}")), kind("SERIES", E(0x20, 0xE, "UI", f"1.{r['n']}.{r['k']}")), *images))

    return dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "directory"), "directory").drop("path")


@query("SELECT CAST(b AS INT) AS beam, 'Beam ' || s_suppkey AS name, CASE WHEN b = 1 THEN s_suppkey / 4.0 END AS meterset FROM supplier, range(1, 3) AS a(b)")
def plan_beams(spark: S, d: str) -> D:
    def content(r: dict) -> bytes:
        group = SEQ(0x300C, 4, E(0x300A, 0x86, "DS", str(r["k"] / 4)) + E(0x300C, 6, "IS", "1"))
        return files.dicom_file(SEQ(0x300A, 0x70, group), SEQ(0x300A, 0xB0, *(E(0x300A, 0xC0, "IS", str(b)) + E(0x300A, 0xC2, "LO", f"Beam {r['k']}") for b in (1, 2))))

    return dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "plans"), "beams").drop("path")


GRID = "SELECT s_suppkey AS k, x, y, z, CAST(s_suppkey AS DOUBLE) / 8 + x + 10 * y + 100 * z AS v FROM supplier, range(0, 4) AS a(x), range(0, 3) AS b(y), range(0, 2) AS c(z)"


def _grid(r: dict) -> np.ndarray:
    z, y, x = np.mgrid[:2, :3, :4]
    return (r["k"] / 8 + x + 10.0 * y + 100 * z).ravel()


def _voxels(frames: D) -> D:
    v = volumes.voxels(frames)
    return v.select(F.regexp_extract("series", r"(\d+)\.\w+$", 1).cast("bigint").alias("k"), *(F.col(c).cast("bigint").alias(c) for c in "xyz"), "v")


@query(GRID)
def nifti_voxels(spark: S, d: str) -> D:
    content = lambda r: volumes.nifti_bytes((4, 3, 2), (1.0, 1.0, 2.0), _grid(r))
    return _voxels(volumes.frames(spark, files.write(_suppliers(spark, d), "file", content, "nifti"), "nifti"))


@query(GRID)
def nrrd_voxels(spark: S, d: str) -> D:
    head = b"NRRD0004\ntype: double\ndimension: 3\nsizes: 4 3 2\nspacings: 1 1 2\nencoding: raw\nendian: little\n\n"
    return _voxels(volumes.frames(spark, files.write(_suppliers(spark, d), "file", lambda r: head + _grid(r).astype("<f8").tobytes(), "nrrd"), "nrrd"))


def _tiff(images: list[np.ndarray], description: str) -> bytes:
    """A TIFF with a deflated strip for each image."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k, image in enumerate(images):
        raw = zlib.compress(image.astype("<u2").tobytes())
        strip = len(out)
        out += raw
        text_at = len(out)
        out += (note := description.encode() + b"\0" if k == 0 else b"")
        h, w = image.shape
        entries = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 16), (259, 3, 1, 8), *([(270, 2, len(note), text_at)] if note else []), (273, 4, 1, strip), (277, 3, 1, 1), (278, 3, 1, h), (279, 4, 1, len(raw)), (339, 3, 1, 1)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@query(f"SELECT k, CAST(f AS INT) AS c, x, y, v FROM ({PICTURE})")
def tiff_planes(spark: S, d: str) -> D:
    note = '<OME><Image><Pixels DimensionOrder="XYCZT" SizeC="2" SizeZ="1" SizeT="1" Type="uint16"/></Image></OME>'
    rows = tiff.planes(spark, files.write(_suppliers(spark, d), "file", lambda r: _tiff([_frame(r, 0), _frame(r, 1)], note), "tiff"))
    i = F.col("i")
    long_ = rows.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("k"), "c", F.posexplode("data").alias("i", "v"))
    return long_.select("k", "c", (i % 5).cast("bigint").alias("x"), F.floor(i / 5).alias("y"), F.col("v").cast("bigint").alias("v"))


@query(f"SELECT k, z, x, y, v FROM (SELECT k, CAST(f AS INT) AS z, x, y, v FROM ({PICTURE})) WHERE z = 1")
def zarr_planes(spark: S, d: str) -> D:
    s = _suppliers(spark, d)
    n = s.agg(F.max("k")).first()[0] + 1  # a place in time for each supplier
    meta = json.dumps({"zarr_format": 2, "shape": [n, 1, 2, 4, 5], "chunks": [1, 1, 2, 4, 5], "dtype": "<u2", "order": "C", "compressor": None, "fill_value": 0, "dimension_separator": "."})
    chunks = s.withColumn("file", F.concat(F.lit("0/"), F.col("k").cast("string"), F.lit(".0.0.0.0")))
    heads = spark.createDataFrame([(-1, 0, ".zattrs"), (-2, 0, "0/.zarray")], chunks.schema)
    contents = {-1: json.dumps({"multiscales": [{"datasets": [{"path": "0"}]}]}).encode(), -2: meta.encode()}
    folder = files.write(chunks.unionByName(heads), "file", lambda r: contents.get(r["k"]) or b"".join(_frame(r, f).tobytes() for f in (0, 1)), "zarr")
    zarr.register(spark)
    rows = spark.read.format("omezarr").load(folder).filter("z = 1")
    i = F.col("i")
    long_ = rows.select(F.col("t").cast("bigint").alias("k"), "z", F.posexplode("data").alias("i", "v"))
    whole = long_.select("k", "z", (i % 5).cast("bigint").alias("x"), F.floor(i / 5).alias("y"), F.col("v").cast("bigint").alias("v"))
    return whole.join(s.select("k"), "k", "left_semi")


@query("SELECT p_partkey AS serial, 'CA' AS atom_name, substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) AS chain, CAST(p_size AS INT) AS res_seq, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 100 AS DOUBLE) / 8 AS z FROM part")
def mmcif_atoms(spark: S, d: str) -> D:
    p = base(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", F.pmod("p_partkey", F.lit(7)).alias("part"))
    row = F.format_string("ATOM %d C \"CA\" 'ALA' %s %d %d.000 1.5 %s 20.50", "k", F.substring(F.lit("ABCD"), (1 + F.col("k") % 4).cast("int"), F.lit(1)), "p_size", "p_size", F.format_string("%.3f", F.col("k") % 100 / 8))
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv"))
    lines = p.select(F.concat(F.col("part").cast("string"), F.lit(".cif")).alias("file"), row.alias("line"))
    atoms = text.mmcif(spark, files.write_lines(lines, "file", "line", "cif", head, "#\n"))
    return atoms.select(*(F.col(c) for c in ("serial", "atom_name", "chain", "res_seq", "x", "z")))


@query("""SELECT 't' || s_suppkey AS transcript, CAST(codon AS BIGINT) AS codon, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS strand, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 100 + codon * 3 - 2 ELSE s_suppkey * 100 + n - codon * 3 + 1 END AS start, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 100 + codon * 3 ELSE s_suppkey * 100 + n - (codon - 1) * 3 END AS "end"
  FROM (SELECT s_suppkey, 6 + s_nationkey AS n FROM supplier), (SELECT unnest(range(1, 12)) AS codon) WHERE codon * 3 <= n""")
def codon_places(spark: S, d: str) -> D:
    k = F.col("s_suppkey")
    s = base(spark, d, "supplier")
    line = tabbed(F.lit("chr1"), "x", "CDS", k * 100 + 1, k * 100 + 6 + F.col("s_nationkey"), ".", F.when(k % 2 == 0, "+").otherwise("-"), "0", F.concat(F.lit('transcript_id "t'), k, F.lit('";')))
    return text.codon_entries(text.gff(spark, written(s.select(line), "gtf"), "gtf")).select("transcript", "codon", "strand", "start", "end")


@query("""SELECT 't' || s_suppkey AS transcript, (6 + s_nationkey) % 3 AS leftover FROM supplier WHERE (6 + s_nationkey) % 3 > 0""")
def partial_codons(spark: S, d: str) -> D:
    k = F.col("s_suppkey")
    line = tabbed(F.lit("chr1"), "x", "CDS", k * 100 + 1, k * 100 + 6 + F.col("s_nationkey"), ".", "+", "0", F.concat(F.lit('transcript_id "t'), k, F.lit('";')))
    return text.partial_codons(text.gff(spark, written(base(spark, d, "supplier").select(line), "gtf"), "gtf"))


@query("SELECT '1.' || o_custkey AS study_uid, '1.' || o_custkey || '.' || o_orderkey AS series_uid, CASE o_orderstatus WHEN 'F' THEN 'CT' ELSE 'MR' END AS modality, CAST(o_orderkey % 9 AS DOUBLE) AS series_number FROM orders")
def series_documents(spark: S, d: str) -> D:
    o = base(spark, d, "orders")
    one = lambda value: F.struct(F.array(value).alias("Value"))
    tags = {"study_uid": F.concat(F.lit("1."), "o_custkey"), "series_uid": F.concat(F.lit("1."), "o_custkey", F.lit("."), "o_orderkey"), "modality": F.when(F.col("o_orderstatus") == "F", "CT").otherwise("MR"), "series_number": F.col("o_orderkey") % 9}
    docs = o.select(F.to_json(F.struct(*(one(v).alias(dicomweb.TAGS[k]) for k, v in tags.items()))).alias("json"))
    return dicomweb.series(docs).select("study_uid", "series_uid", "modality", "series_number")


@query("SELECT CAST(k AS INT) AS part_no, CASE k WHEN 0 THEN 'application/dicom' ELSE 'text/plain' END AS content_type, CASE k WHEN 0 THEN '/s/' || s_suppkey END AS location, CASE k WHEN 0 THEN s_name ELSE 'x' || s_nationkey END AS content FROM supplier, range(0, 2) AS a(k)")
def multipart_bodies(spark: S, d: str) -> D:
    crlf = "\r\n"
    body = F.concat(F.lit(f"--B{crlf}Content-Type: application/dicom{crlf}Content-Location: /s/"), "s_suppkey", F.lit(crlf * 2), "s_name", F.lit(f"{crlf}--B{crlf}Content-Type: text/plain{crlf * 2}x"), "s_nationkey", F.lit(f"{crlf}--B--{crlf}"))
    docs = base(spark, d, "supplier").select(body.cast("binary").alias("body"), F.lit("B").alias("boundary"))
    return reports.multipart(docs).select("part_no", "content_type", "location", F.col("content").cast("string").alias("content"))


@query("SELECT CAST(series AS STRING) AS series, label || ' · SR import' AS label, 'length' AS kind, round(value, 2) AS value FROM measurements", "measurements")
def report_round_trip(spark: S, d: str) -> D:
    m = domain(spark, d, "measurements").withColumn("points", F.array(F.struct(F.lit(1.0).alias("u"), F.lit(2.0).alias("v"))))
    return reports.read(reports.build(m)).select(F.col("series").cast("string").alias("series"), "label", "kind", F.round("value", 2).alias("value"))


STACK = "SELECT p_partkey AS row_no, 's' || p_partkey % 40 AS uid, (p_partkey // 40) % 25 * 2.5 AS z, p_partkey // 1000 AS phase FROM part"


def _slices(spark: S, d: str) -> D:
    k = F.col("p_partkey")
    return base(spark, d, "part").select(
        k.alias("row_no"), F.concat(F.lit("s"), (k % 40).cast("string")).alias("series_uid"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0))).alias("iop"),
        F.array(F.lit(0.0), F.lit(0.0), F.floor(k / 40) % 25 * 2.5).alias("ipp"), F.array(F.lit(0.5), F.lit(0.5)).alias("pixel_spacing"), F.floor(k / 1000).cast("int").alias("instance_number"), F.lit(0).alias("frame_index"),
    )


@query(f"""WITH s AS ({STACK}), p AS (SELECT *, dense_rank() OVER (PARTITION BY uid ORDER BY z) - 1 AS place, row_number() OVER (PARTITION BY uid, z ORDER BY phase, row_no) - 1 AS ph FROM s), c AS (SELECT uid, z, count(*) AS n FROM s GROUP BY 1, 2), e AS (SELECT uid, min(n) = max(n) AND count(*) > 1 AS even, max(n) AS most FROM c GROUP BY 1)
  SELECT row_no, CAST(place AS INT) AS place, CASE WHEN even AND most > 1 THEN CAST(ph AS INT) END AS phase, CASE WHEN NOT even AND most > 1 THEN 'duplicate-position' END AS warning FROM p JOIN e USING (uid) WHERE even OR ph = 0""")
def image_stacks(spark: S, d: str) -> D:
    return stacks.stacks(_slices(spark, d)).select("row_no", "place", "phase", "warning")


@query(f"SELECT row_no, round(z, 3) AS along FROM ({STACK})")
def slice_positions(spark: S, d: str) -> D:
    return _slices(spark, d).select("row_no", F.round(stacks.along_normal(), 3).alias("along"))


@query("SELECT o_orderkey FROM orders")
def seeded_permutation(spark: S, d: str) -> D:
    return ordered.seeded_order(base(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("SELECT point_id, round(0.5 * x - y + 3, 6) AS wx, round(x + 0.25 * z - 1, 6) AS wy, round(2 * z, 6) AS wz FROM points", "points")
def world_places(spark: S, d: str) -> D:
    m = scalars.compose_affine([1, 0, 0, 3, 0, 1, 0, -1, 0, 0, 2, 0], [0.5, -1, 0, 0, 1, 0, 0.25, 0, 0, 0, 1, 0])
    p = domain(spark, d, "points")
    return p.select("point_id", *(F.round(c, 6).alias(f"w{n}") for n, c in zip("xyz", scalars.affine([float(v) for v in m], *(F.col(c) for c in "xyz")), strict=True)))


@query("SELECT p_partkey, CASE WHEN n IS NULL THEN '—' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 > 0 THEN p_size * p_size * p_partkey * (p_partkey % 7 + 1) * 131 END AS n FROM part)")
def byte_texts(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return base(spark, d, "part").select("p_partkey", scalars.bytes_text(F.when(k % 50 > 0, s * s * k * (k % 7 + 1) * 131)).alias("size"))


@query("SELECT s_suppkey AS case_id, round((s_suppkey % 5) / 4.0, 6) AS difference, (s_suppkey % 5) / 4.0 <= 0.5 AND s_suppkey % 3 > 0 AS agree FROM supplier")
def graded_cases(spark: S, d: str) -> D:
    k = F.col("s_suppkey")
    cases = base(spark, d, "supplier").select(k.alias("case_id"), (F.col("s_nationkey") + k % 5 / 4.0).alias("measured_sum"), F.col("s_nationkey").cast("double").alias("published_sum"), F.lit("PR").alias("picked"), F.when(k % 3 > 0, "PR").otherwise("SD").alias("published"))
    return quality.grade(cases).select("case_id", F.round("difference", 6).alias("difference"), "agree")


@query("SELECT o_custkey AS component, count(*) AS n FROM orders GROUP BY 1")
def island_sizes(spark: S, d: str) -> D:
    return graph.sizes(base(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("component")))


LIT = "q AS (SELECT tile, x, y, CASE WHEN v > 60 THEN 1 ELSE 0 END AS mask, v FROM pixels), m AS (SELECT tile, avg(v) FILTER (mask = 1) AS a, avg(v) FILTER (mask = 0) AS b FROM q GROUP BY 1)"


@query(f""", {LIT}, n AS (SELECT p.tile, p.x, p.y, min(o.mask) AS lo, max(o.mask) AS hi FROM q p JOIN q o ON o.tile = p.tile AND abs(o.x - p.x) <= 1 AND abs(o.y - p.y) <= 1 GROUP BY 1, 2, 3)
  SELECT tile, x, y, CAST(CASE WHEN lo <> hi AND a <> b THEN (abs(v - a) <= abs(v - b))::INT ELSE mask END AS INT) AS mask FROM q JOIN n USING (tile, x, y) JOIN m USING (tile)""", "pixels")
def level_set_pass(spark: S, d: str) -> D:
    p = domain(spark, d, "pixels").withColumn("mask", (F.col("v") > 60).cast("int"))
    return voxels.level_set(p, 1).select("tile", "x", "y", "mask")


@query("SELECT CAST(s_suppkey % 6 AS INT) AS tile, CAST(s_suppkey AS INT) AS request, CAST(k AS INT) AS step, CAST(s_nationkey + k AS INT) AS x, CAST(s_suppkey % 40 AS INT) AS y FROM supplier, range(0, 8) AS a(k)")
def straight_paths(spark: S, d: str) -> D:
    """Where nothing stands out, the cheapest path between two pixels of a row is the row."""
    k = F.col("s_suppkey")
    flat = domain(spark, d, "pixels").select("tile", "x", "y", F.lit(0.0).alias("gradient"))
    asked = base(spark, d, "supplier").select((k % 6).cast("int").alias("tile"), k.cast("int").alias("request"), F.col("s_nationkey").cast("int").alias("sx"), (k % 40).cast("int").alias("sy"), (F.col("s_nationkey") + 7).cast("int").alias("tx"), (k % 40).cast("int").alias("ty"))
    return paths.livewire(flat, asked, 48, 40)


TRACTS = "SELECT s_suppkey AS file, CAST(i AS INT) AS k, CAST(s_suppkey % 100 + i AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(i * j AS DOUBLE) AS z FROM supplier, range(0, 3) AS a(j), range(0, 6) AS b(i) WHERE i < 2 + 2 * j"


def _lines(r: dict) -> list[list[tuple[float, ...]]]:
    return [[(float(r["k"] % 100 + i), float(r["n"]), float(i * j)) for i in range(2 + 2 * j)] for j in range(3)]


@query(TRACTS)
def tck_points(spark: S, d: str) -> D:
    rows = tracts.points(spark, files.write(_suppliers(spark, d), "file", lambda r: tracts.tck_bytes(_lines(r)), "tck"), size=96)
    return rows.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("file"), "k", "x", "y", "z")


@query(f"SELECT file, k, x * 2 + 1 AS x, y, z - 3 AS z, x AS weight FROM ({TRACTS})")
def trk_points(spark: S, d: str) -> D:
    matrix = np.array([[2, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, -3], [0, 0, 0, 1]])
    content = lambda r: tracts.trk_bytes([[(*p, p[0]) for p in line] for line in _lines(r)], 1, matrix)
    rows = tracts.points(spark, files.write(_suppliers(spark, d), "file", content, "trk"), size=120)
    return rows.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("file"), "k", "x", "y", "z", F.get("scalars", 0).cast("double").alias("weight"))


def _assembly_text(r: dict) -> bytes:
    """An entry with two operators, of which the second moves by the supplier's number, and two sets of chains."""
    operator = lambda k, x: f"{k} 1 0 0 {x} 0 1 0 0 0 0 1 0"
    tags = "".join(f"_pdbx_struct_oper_list.{t}\n" for t in ("id", *text.MATRIX_ITEMS))
    gens = "".join(f"_pdbx_struct_assembly_gen.{t}\n" for t in ("assembly_id", "oper_expression", "asym_id_list"))
    single = f"_pdbx_struct_assembly.id 1\n_pdbx_struct_assembly.details 'no. {r['k']}'\n"
    return f"data_x\n{single}loop_\n{gens}1 (1-2) A,B\n1 '(1,2)(P)' C\nloop_\n{tags}{operator(1, 0)}\n{operator(2, r['k'])}\n{operator('P', r['n'])}\n#\n".encode()


CIF_NAMES = ["pdbx_struct_assembly", "pdbx_struct_assembly_gen", "pdbx_struct_oper_list"]


def _cif(spark: S, d: str) -> D:
    rows = text.cif_categories(spark, files.write(_suppliers(spark, d), "file", _assembly_text, "assemblies"), CIF_NAMES)
    return rows.withColumn("file", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint"))


@query("SELECT s_suppkey AS file, '1' AS assembly, CAST(c AS INT) AS copy_no, a AS asym, CASE WHEN a = 'C' THEN (c + 1) || '.P' ELSE (c + 1) || '' END AS ops FROM supplier, (VALUES ('A'), ('B'), ('C')) t(a), range(0, 2) AS b(c)")
def cif_copies(spark: S, d: str) -> D:
    rows = _cif(spark, d)
    made = text.cif_copies(rows).join(rows.select("path", "file").distinct(), "path")
    return made.select("file", "assembly", "copy_no", "asym", F.array_join("ops", ".").alias("ops"))


@query("SELECT s_suppkey AS file, op, CASE op WHEN '1' THEN 0.0 WHEN '2' THEN CAST(s_suppkey AS DOUBLE) ELSE CAST(s_nationkey AS DOUBLE) END AS shift, CAST(3 AS DOUBLE) AS diagonal FROM supplier, (VALUES ('1'), ('2'), ('P')) t(op)")
def cif_operators(spark: S, d: str) -> D:
    rows = _cif(spark, d)
    made = text.cif_operators(rows).join(rows.select("path", "file").distinct(), "path")
    return made.select("file", "op", F.get("m", 3).alias("shift"), (F.get("m", 0) + F.get("m", 5) + F.get("m", 10)).alias("diagonal"))


@query("SELECT s_suppkey AS file, '1' AS id, 'no. ' || s_suppkey AS details FROM supplier")
def cif_single_items(spark: S, d: str) -> D:
    rows = _cif(spark, d).filter("category = 'pdbx_struct_assembly'")
    return rows.select("file", F.col("items")["id"].alias("id"), F.col("items")["details"].alias("details"))

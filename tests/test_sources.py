import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from morpholake.sources import sinks, text, volumes


def put(tmp_path, name, content):
    (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path / name)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one first\nACGT\n  TT \n\n>two\r\nGG\r\nCC\r\n>three\n")
    assert {r.id: r.seq for r in text.fasta(spark, path).collect()} == {"one": "ACGTTT", "two": "GGCC", "three": ""}


def test_vcf_and_depth(spark, tmp_path):
    head = "##x\n#CHROM\n\n"
    row = lambda info, fmt="", s="": f"chr1\t10\t.\tA\tG,T\t.\t.\t{info}\t{fmt}\t{s}\n"
    path = put(tmp_path, "a.vcf", head + row("DP=30", "GT:AD", "0/1:20,10") + row(".", "AD", "5,15") + row("X=1;DP=12") + row(".") + row("DP=7", "AD", "x,3"))
    assert sorted(str((r.depth, r.alt_frac and round(r.alt_frac, 4))) for r in text.vcf_depth(spark, path).collect()) == sorted(["(30, 0.3333)", "(20, 0.75)", "(12, None)", "(None, None)", "(7, None)"])
    first = text.vcf(spark, path).first()
    assert (first.chrom, first.pos, first.ref, first.alt) == ("chr1", 10, "A", "G,T")
    with pytest.raises(Exception, match="vcf-depth-columns"):
        text.vcf_depth(spark, put(tmp_path, "b.vcf", "chr1\t3\n")).collect()


def test_bed_and_gff(spark, tmp_path):
    rows = text.bed(spark, put(tmp_path, "a.bed", "track x\n#c\nchr1\t0\t10\tn\t5.5\t+\nchr1\t1\nchr2\t3\t4\n")).orderBy("chrom").collect()
    assert [(r.chrom, r.start, r.end, r.name, r.score) for r in rows] == [("chr1", 0, 10, "n", 5.5), ("chr2", 3, 4, None, None)]
    g = text.gff(spark, put(tmp_path, "a.gff", "chr1\ts\tgene\t1\t9\t.\t-\t.\tID=g1;Name=a%3Bb\nshort\trow\n")).collect()
    assert len(g) == 1 and g[0].score is None and g[0].strand == "-" and g[0].attributes == {"ID": "g1", "Name": "a;b"}


def test_codons(spark, tmp_path):
    line = lambda t, s, e, strand="+": f'c\tx\tCDS\t{s}\t{e}\t.\t{strand}\t0\ttranscript_id "{t}";\n'
    gtf = text.gff(spark, put(tmp_path, "a.gtf", line("T", 200, 203) + line("T", 100, 104) + line("P", 300, 306) + line("M", 500, 505, "-")), "gtf")
    rows = {}
    for r in text.codon_entries(gtf).orderBy("start").collect():
        rows.setdefault(r.transcript, []).append((r.start, r.end, r.codon))
    assert rows["T"] == [(100, 102, 1), (103, 104, 2), (200, 200, 2), (201, 203, 3)]
    assert rows["P"] == [(300, 302, 1), (303, 305, 2)] and rows["M"] == [(500, 502, 2), (503, 505, 1)]
    assert [tuple(r) for r in text.partial_codons(gtf).collect()] == [("P", 1)]
    for bad, name in ((line("T", 1, 3) + line("T", 9, 12, "-"), "gtf-cds-split-transcript"), (line("T", 9, 7), "gtf-cds-row: bad interval"), (line("T", 7, 9, "."), "gtf-cds-row: strand"), (line("T", 7, 9).replace("transcript_id", "gene_id"), "gtf-cds-no-transcript-id")):
        with pytest.raises(Exception, match=name):
            text.codon_entries(text.gff(spark, put(tmp_path, "bad.gtf", bad), "gtf")).collect()


PDB = "ATOM      1  CA  ALA A  12      11.000  12.500  -3.000  1.00 20.50           C  \nATOM      2  N   GLY A  13      bad    12.500  -3.000  1.00 20.50           N  \nHETATM    3  O   HOH A  99       1.000   1.000   1.000  1.00  1.00           O  \nATOM      4  CB  ALA A  12      12.000  12.500  -3.000  1.00 21.50           C  \n"
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
ATOM 1 C CA ALA A 12 11.000 12.500 -3.000 20.50
HETATM 3 O O HOH A ? 1 1 1 1
ATOM 4 C "CB" 'ALA' A 12 12.000 12.500 -3.000 21.50
ATOM 5 C CX ALA A 12 ? 12.500 -3.000 21.50
#
_entry.id 1ABC
"""


def test_both_structure_readers_agree(spark, tmp_path):
    a = text.pdb(spark, put(tmp_path, "a.pdb", PDB)).orderBy("serial").collect()
    b = text.mmcif(spark, put(tmp_path, "a.cif", CIF)).orderBy("serial").collect()
    assert a == b and len(a) == 2 and a[0].bfactor == 20.5
    assert text.residues(text.pdb(spark, str(tmp_path / "a.pdb"))).collect()[0].asDict() == {"chain": "A", "res_seq": 12, "res_name": "ALA", "first": 1}


def test_cif_files_are_read_in_passing(spark, tmp_path):
    """The rows of a loop come before the rest of its file has been asked for; a file of several batches is whole."""
    read = []

    def lines():
        for k, line in enumerate(["loop_", "_a.x", "_a.y", *(f"{k} 'v {k}'" for k in range(100)), ";open", "b c"]):
            read.append(k)
            yield line

    loops = text.cif_stream(lines())
    names, rows = next(loops)
    assert names == ["_a.x", "_a.y"] and next(rows) == ["0", "v 0"] and len(read) < 6
    assert [list(r)[-1] for _, r in [(names, rows)]] == [[";open", "b"]] and next(loops, None) is None
    atoms = "".join(f"ATOM {k} C CA ALA A 12 {k}.000 12.500 -3.000 20.50\n" for k in range(25_000))
    put(tmp_path, "many atoms.cif", CIF[: CIF.index("ATOM 1 ")] + atoms + "#\n")
    got = text.mmcif(spark, str(tmp_path / "many atoms.cif"))
    assert got.agg(F.count("serial"), F.sum("x"), F.max("serial")).first()[:] == (25_000, sum(range(25_000)), 24_999)


def test_cif_values():
    loops = dict((n[0], r) for n, r in text.cif_loops("_a.b 'it''s'\n_c.d\n;long\ntext\n;\nloop_\n_e.f\n_e.g\n1 \"x y\" # no\n2 z\n"))
    assert loops["_c.d"] == [["long\ntext"]] and loops["_e.f"] == [["1", "x y"], ["2", "z"]]


def test_radiomics(spark):
    wide = spark.createDataFrame([("L1", 1.0, 2.0)], "label string, mean double, sd double")
    assert sorted((r.feature, r.value) for r in text.radiomics_long(wide, "label", ["mean", "sd"]).collect()) == [("mean", 1.0), ("sd", 2.0)]
    with pytest.raises(Exception, match="radiomics-bad-value"):
        text.radiomics_long(wide.withColumn("sd", F.lit(float("nan"))), "label", ["mean", "sd"]).collect()


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(24, dtype=float) * 1.5
    raw = volumes.nifti_bytes((4, 3, 2), (1.0, 2.0, 2.5), data)
    put(tmp_path, "a.nii.gz", gzip.compress(raw))
    frame = volumes.frames(spark, str(tmp_path / "a.nii.gz"), "nifti")
    r = frame.first()
    assert (r.nx, r.ny, r.nz, r.sz, r.dtype) == (4, 3, 2, 2.5, "f8") and r.data == data.tolist()
    v = {(x.x, x.y, x.z): x.v for x in volumes.voxels(frame).collect()}
    assert v[1, 2, 1] == data[12 + 2 * 4 + 1]
    with pytest.raises(ValueError, match="nifti-short-data"):
        list(volumes.nifti_frames(raw[:-8]))
    big = bytearray(raw[:352])
    for fmt, at in (("i", 0), ("8h", 40), ("2h", 70), ("8f", 76), ("3f", 108)):
        struct.pack_into(f">{fmt}", big, at, *struct.unpack_from(f"<{fmt}", raw, at))
    assert next(volumes.nifti_frames(bytes(big) + data.astype(">f8").tobytes()))[4].tolist() == data.tolist()


@pytest.mark.parametrize("encoding", ["raw", "gzip", "ascii"])
def test_nrrd(spark, tmp_path, encoding):
    data = np.arange(8, dtype=np.int16) - 3
    body = {"raw": data.tobytes(), "gzip": gzip.compress(data.tobytes()), "ascii": " ".join(map(str, data)).encode()}[encoding]
    path = put(tmp_path, "a.nrrd", f"NRRD0004\n# c\ntype: short\ndimension: 3\nsizes: 2 2 2\nspace directions: (0,3,0) (1,0,0) (0,0,2)\nendian: little\nencoding: {encoding}\n\n".encode() + body)
    r = volumes.frames(spark, path, "nrrd").first()
    assert r.data == data.tolist() and (r.sx, r.sy, r.sz) == (3.0, 1.0, 2.0)
    with pytest.raises(ValueError, match="nrrd-dimension"):
        list(volumes.nrrd_frames(b"NRRD0004\ndimension: 2\n\n"))


def test_sniffing(spark):
    rows = [(b"NRRD0004",), (b"\x1f\x8b\x08",), (b"\0" * 128 + b"DICM",), (b"II*\0",), (b"none",)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(volumes.sniff(F.col("c"))).collect()] == ["nrrd", "gzip", "dicom", "tiff", None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", 'say "x", y', "length", 1.23456, "mm"), (2, "s", "b", "roi", None, "HU")], "row_no int, series string, label string, kind string, value double, unit string")
    assert [r[0] for r in sinks.measurement_lines(rows.orderBy("row_no")).collect()] == ['"say ""x"", y",length,1.235,mm', "b,roi,,HU"]
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    assert '"row_no":1' in sinks.report_json(rows, "series").first().json

"""Genome and structure text formats as tables: one scan each, split by Spark, parsed by column functions."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import integer_prefix, number_prefix
from ..functions.scalars import attributes


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, split at tabs."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select("value", F.split("value", "\t").alias("f"))


def _at(k: int) -> Column:
    return F.get("f", k)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, seq.  Records are cut at the headers by Spark's own line separator, so a large file is read in splits; the lines
    of a record are trimmed and joined.  A file is expected to begin with a header."""
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    lines = F.split(body, r"\r?\n")
    head = F.get(lines, 0)
    seq = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit("")))), "")
    return records.filter(F.trim(body) != "").select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("id"), seq.alias("seq"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt; several alternatives stay one string."""
    return _fields(spark, path).select(_at(0).alias("chrom"), integer_prefix(_at(1)).alias("pos"), _at(3).alias("ref"), _at(4).alias("alt"))


def depth_and_fraction(info: Column, keys: Column, sample: Column) -> tuple[Column, Column]:
    """INFO DP, else the sum of the first sample's AD; the alternative's share of AD.  A malformed AD counts as none."""
    dp = F.regexp_extract(info, r"(?:^|;)DP=(\d+)", 1).try_cast("int")
    place = F.array_position(F.split(keys, ":"), "AD")
    parts = F.when(place > 0, F.split(F.get(F.split(sample, ":"), (place - 1).cast("int")), ","))
    ad = F.transform(parts, lambda x: x.try_cast("int"))
    ok = (F.size(ad) >= 2) & ~F.exists(ad, lambda x: x.isNull())
    total = F.when(ok, F.aggregate(ad, F.lit(0), lambda s, x: s + x))
    rest = F.aggregate(F.slice(ad, 2, F.greatest(F.size(ad), F.lit(1))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(dp, total), F.when(total > 0, rest / total)


def vcf_depth(spark: SparkSession, path: str) -> DataFrame:
    """vcf() with depth and alt_frac; a row of fewer than eight columns raises vcf-depth-columns."""
    wide = F.when(F.size("f") >= 8, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("vcf-depth-columns: "), F.col("value"))).cast("array<string>"))
    rows = _fields(spark, path).select("value", wide.alias("f"))
    depth, share = depth_and_fraction(_at(7), F.coalesce(_at(8), F.lit("")), F.coalesce(_at(9), F.lit("")))
    return rows.select(_at(0).alias("chrom"), integer_prefix(_at(1)).alias("pos"), _at(3).alias("ref"), _at(4).alias("alt"), depth.alias("depth"), share.alias("alt_frac"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end (half-open, from 0), name, score, strand; rows of fewer than three columns are left out."""
    rows = _fields(spark, path).filter(~F.col("value").startswith("track") & (F.size("f") >= 3))
    return rows.select(_at(0).alias("chrom"), integer_prefix(_at(1)).alias("start"), integer_prefix(_at(2)).alias("end"), _at(3).alias("name"), number_prefix(_at(4)).alias("score"), _at(5).alias("strand"))


def gff(spark: SparkSession, path: str, dialect: str = "gff3") -> DataFrame:
    """The nine columns of GFF3 or GTF, `.` as null, attributes as a map; rows of fewer columns are left out."""
    rows = _fields(spark, path).filter(F.size("f") >= 9)
    known = lambda k: F.nullif(_at(k), F.lit("."))
    return rows.select(
        _at(0).alias("seqid"), _at(1).alias("source"), _at(2).alias("type"), integer_prefix(_at(3)).alias("start"), integer_prefix(_at(4)).alias("end"), number_prefix(known(5)).alias("score"), known(6).alias("strand"), attributes(_at(8), dialect).alias("attributes")
    )


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """serial, atom_name, res_name, chain, res_seq, x, y, z, bfactor, element of ATOM lines with coordinates."""
    part = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    rows = spark.read.text(path).filter(F.col("value").startswith("ATOM  "))
    out = rows.select(
        part(7, 11).try_cast("bigint").alias("serial"), part(13, 16).alias("atom_name"), part(18, 20).alias("res_name"), part(22, 22).alias("chain"), part(23, 26).try_cast("int").alias("res_seq"),
        *(part(31 + 8 * k, 38 + 8 * k).try_cast("double").alias(c) for k, c in enumerate("xyz")), part(61, 66).try_cast("double").alias("bfactor"), part(77, 78).alias("element"),
    )
    return out.filter("x is not null and y is not null and z is not null")


def residues(atoms: DataFrame) -> DataFrame:
    """chain, res_seq, res_name, first (serial of the first atom): the residues in the order of first."""
    return atoms.groupBy("chain", "res_seq").agg(F.min_by("res_name", "serial").alias("res_name"), F.min("serial").alias("first"))


ATOM_SITE = T.StructType([T.StructField("serial", T.LongType()), T.StructField("atom_name", T.StringType()), T.StructField("res_name", T.StringType()), T.StructField("chain", T.StringType()), T.StructField("res_seq", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "xyz"), T.StructField("bfactor", T.DoubleType()), T.StructField("element", T.StringType())])
TOKEN = re.compile(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|#.*|(\S+)", re.S)
#: Rows that a task makes into one batch.
BATCH = 10_000


def cif_tokens(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """(word, whether it is bare) of lines without their ends; no more than a line or a text between semicolons is held."""

    def words(line: str) -> Iterator[tuple[str, bool]]:
        if not any(c in line for c in "'\"#"):
            yield from ((w, True) for w in line.split())
            return
        for m in TOKEN.finditer(line):
            if m[3] is not None:
                yield m[3], True
            elif not m[0].startswith("#"):
                yield m[1] if m[1] is not None else m[2], False

    held: list[str] | None = None
    for line in lines:
        if held is None and line.startswith(";"):
            held = [line]
        elif held is None:
            yield from words(line)
        elif line.startswith(";"):
            yield "\n".join(held)[1:], False
            yield from words(line[1:])
            held = None
        else:
            held.append(line)
    for line in held or []:  # never closed, so no text
        yield from words(line)


def cif_stream(lines: Iterable[str]) -> Iterator[tuple[list[str], Iterator[list[str]]]]:
    """(names, rows) of every loop of a CIF file; a single item counts as a loop of one row.  Rows are read as they are asked
    for, and what has not been asked for is passed over."""
    tokens = cif_tokens(lines)
    now = next(tokens, None)

    def values(n: int) -> Iterator[list[str]]:
        nonlocal now
        row: list[str] = []
        while now is not None and not (now[1] and (now[0].startswith("_") or now[0].lower() == "loop_" or now[0].lower().startswith("data_"))):
            row.append(now[0])
            now = next(tokens, None)
            if len(row) == n:
                yield row
                row = []

    while now is not None:
        word, bare = now
        now = next(tokens, None)
        if bare and word.lower() == "loop_":
            names = []
            while now is not None and now[1] and now[0].startswith("_"):
                names.append(now[0])
                now = next(tokens, None)
            rows = values(len(names))
            yield names, rows
            for _ in rows:
                pass
        elif bare and word.startswith("_") and now is not None:
            value, now = now[0], next(tokens, None)
            yield [word], iter([[value]])


def cif_loops(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """cif_stream of a whole text, with lists of rows."""
    return ((names, list(rows)) for names, rows in cif_stream(text.split("\n")))


def _cif_lines(uri: str) -> Iterator[str]:
    """The lines of a file of any store, unpacked as its ending says, without their ends; the file is read in passing."""
    store, place = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(place) as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n") as lines:
        for line in lines:
            yield line.removesuffix("\n")


def _cif_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))


def mmcif(spark: SparkSession, path: str) -> DataFrame:
    """The columns of pdb() from the atom_site loop: author columns, else label columns; ATOM rows only.

    A task reads a file in passing and holds one batch of its atoms, however large the file."""
    arrow = pa.schema([("serial", pa.int64()), ("atom_name", pa.string()), ("res_name", pa.string()), ("chain", pa.string()), ("res_seq", pa.int32()), *((c, pa.float64()) for c in "xyz"), ("bfactor", pa.float64()), ("element", pa.string())])

    def number(s: str | None) -> float | None:
        try:
            return float(s) if s is not None else None
        except ValueError:
            return None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column(0).to_pylist()):
            out: list[tuple] = []
            for names, rows in cif_stream(_cif_lines(uri)):
                short = [n.split(".")[-1] for n in names]
                if "_atom_site.Cartn_x" not in names:
                    continue
                for row in rows:
                    v = dict(zip(short, row, strict=False))
                    get = lambda *keys, v=v: next((v[k] for k in keys if v.get(k) not in (None, "?", ".")), None)
                    xyz = [number(v.get(f"Cartn_{c}")) for c in "xyz"]
                    if v.get("group_PDB", "ATOM") == "ATOM" and None not in xyz:
                        seq, serial = number(get("auth_seq_id", "label_seq_id")), number(get("id"))
                        out.append((None if serial is None else int(serial), get("auth_atom_id", "label_atom_id"), get("auth_comp_id", "label_comp_id"), get("auth_asym_id", "label_asym_id"), None if seq is None else int(seq), *xyz, number(get("B_iso_or_equiv")), get("type_symbol")))
                        if len(out) >= BATCH:
                            yield batch_of(out)
                            out = []
                break
            if out:
                yield batch_of(out)

    return _cif_files(spark, path).mapInArrow(run, ATOM_SITE)


CATEGORY = T.StructType([T.StructField("path", T.StringType()), T.StructField("category", T.StringType()), T.StructField("row_no", T.IntegerType()), T.StructField("items", T.MapType(T.StringType(), T.StringType()))])


def cif_categories(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """path, category, row_no and items (item -> value) of these categories, whether a file writes them as loops or as single
    items, which together are one row.  An item without a value raises."""
    wanted = set(names)

    def rows_of(lines: Iterable[str]) -> Iterator[tuple[str, int, dict[str, str]]]:
        count: dict[str, int] = {}
        first: dict[str, dict[str, str]] = {}  # a category's only row so far, which single items may still add to
        for tags, rows in cif_stream(lines):
            category = tags[0][1:].partition(".")[0] if tags else ""
            if category not in wanted:
                continue
            items = [t[len(category) + 2 :] for t in tags]
            some = list(islice(rows, 2))
            single = len(tags) == 1 and len(some) == 1
            if single and category in first and items[0] not in first[category]:
                first[category][items[0]] = some[0][0]
                continue
            for row in chain(some, rows):
                made = dict(zip(items, row, strict=True))
                k = count.get(category, 0)
                count[category] = k + 1
                if k == 0:
                    first[category] = made
                    continue
                if k == 1:
                    yield category, 0, first.pop(category)
                yield category, k, made
        for category, row in first.items():
            yield category, 0, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column(0).to_pylist()):
            rows = rows_of(_cif_lines(uri))
            while made := list(islice(rows, BATCH)):
                category, k, items = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(made)), pa.array(category), pa.array(k, pa.int32()), pa.array([list(i.items()) for i in items], pa.map_(pa.string(), pa.string()))], names=CATEGORY.names)

    return _cif_files(spark, path).mapInArrow(run, CATEGORY)


#: Items of an operator's matrix, row by row.
MATRIX_ITEMS = tuple(f"matrix[{r}][{c}]" if c < 4 else f"vector[{r}]" for r in (1, 2, 3) for c in (1, 2, 3, 4))


def cif_operators(categories: DataFrame) -> DataFrame:
    """path, op, m (12 numbers, row by row) of pdbx_struct_oper_list; an operator that lacks a number raises."""
    rows = categories.filter("category = 'pdbx_struct_oper_list'")
    numbers = F.array(*(F.try_element_at("items", F.lit(k)).try_cast("double") for k in MATRIX_ITEMS))
    op = F.try_element_at("items", F.lit("id"))
    whole = ~F.exists(numbers, lambda x: x.isNull())
    return rows.select("path", op.alias("op"), F.when(whole, numbers).otherwise(F.raise_error(F.concat(F.lit("assembly-operator: "), F.coalesce(op, F.lit("?")))).cast("array<double>")).alias("m"))


def cif_copies(categories: DataFrame) -> DataFrame:
    """path, assembly, gen, copy_no, asym, ops: every chain under every product of operators that its assembly asks for.

    A product is its operators from the left; the last of them is applied first."""
    from ..operators.joins import operator_products

    item = lambda k: F.try_element_at("items", F.lit(k))
    gens = categories.filter("category = 'pdbx_struct_assembly_gen'").select("path", item("assembly_id").alias("assembly"), F.col("row_no").alias("gen"), item("oper_expression").alias("_e"), item("asym_id_list").alias("_a"))
    copies = gens.select("path", "assembly", "gen", "_a", F.posexplode(operator_products(F.col("_e"))).alias("copy_no", "ops"))
    chains = F.filter(F.transform(F.split("_a", ","), F.trim), lambda a: a != "")
    return copies.select("path", "assembly", "gen", "copy_no", F.explode(chains).alias("asym"), "ops")


def radiomics_long(wide: DataFrame, label: str, features: list[str]) -> DataFrame:
    """label, feature, value: one row per feature of each row; a value that is not finite or an empty label raises."""
    long_ = wide.unpivot(label, features, "feature", "value")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")) | (F.coalesce(F.trim(label), F.lit("")) == "")
    return long_.withColumn("value", F.when(~bad, F.col("value")).otherwise(F.raise_error(F.format_string("radiomics-bad-value: %s %s", F.coalesce(F.col(label), F.lit("")), F.col("feature"))).cast("double")))


def _coding(features: DataFrame) -> DataFrame:
    """The CDS rows of a GTF with their place in their transcript: before, the bases of the exons before along the strand, and
    total.  A row without a transcript, with a bad interval or strand, or of a transcript on two strands or contigs raises."""
    from pyspark.sql import Window

    bad = lambda why: F.raise_error(F.concat(F.lit(why), F.concat_ws(":", "seqid", "start", "end")))
    whole = F.col("seqid").isNotNull() & (F.col("start") >= 1) & (F.col("end") >= F.col("start"))
    checked = F.when(~F.coalesce(whole, F.lit(False)), bad("gtf-cds-row: bad interval ")).when(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)), bad("gtf-cds-row: strand of ")).otherwise(F.coalesce(F.col("attributes")["transcript_id"], bad("gtf-cds-no-transcript-id: ")))
    cds = features.filter("type = 'CDS'").select("seqid", "strand", "start", "end", checked.cast("string").alias("transcript"))
    home = Window.partitionBy("transcript")
    one = (F.min("seqid").over(home) == F.max("seqid").over(home)) & (F.min("strand").over(home) == F.max("strand").over(home))
    cds = cds.withColumn("transcript", F.when(one, F.col("transcript")).otherwise(F.raise_error(F.concat(F.lit("gtf-cds-split-transcript: "), "transcript")).cast("string")))
    along = home.orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")))
    n = F.col("end") - F.col("start") + 1
    return cds.withColumn("before", F.sum(n).over(along) - n).withColumn("total", F.sum(n).over(home))


def codon_entries(features: DataFrame) -> DataFrame:
    """Codon entries of the CDS rows of a GTF: transcript, chrom, codon (from 1), start, end, strand.

    A base's place in its transcript is its offset in its exon plus the lengths of the exons before it (along the strand):
    a running sum over exons, then a division by three.  A codon over two exons gives an entry for each; leftover bases
    after the last whole codon give none (partial_codons tells of them)."""
    placed, n = _coding(features), F.col("end") - F.col("start") + 1
    codons = placed.withColumn("codon", F.explode(F.sequence(F.floor(F.col("before") / 3), F.floor((F.col("before") + n - 1) / 3)))).filter("codon < floor(total / 3)")
    first = F.greatest(F.col("codon") * 3, F.col("before")) - F.col("before")
    last = F.least(F.col("codon") * 3 + 2, F.col("before") + n - 1) - F.col("before")
    minus = F.col("strand") == "-"
    low, high = F.when(minus, F.col("end") - last).otherwise(F.col("start") + first), F.when(minus, F.col("end") - first).otherwise(F.col("start") + last)
    return codons.select("transcript", F.col("seqid").alias("chrom"), (F.col("codon") + 1).alias("codon"), low.alias("start"), high.alias("end"), F.when(minus, -1).otherwise(1).alias("strand"))


def partial_codons(features: DataFrame) -> DataFrame:
    """transcript, leftover: transcripts whose CDS is no whole number of codons, and how many bases are over."""
    return _coding(features).groupBy("transcript").agg((F.max("total") % 3).alias("leftover")).filter("leftover > 0")

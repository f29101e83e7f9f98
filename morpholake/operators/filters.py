"""Selections: residues, worklists, loci, tags, and the rule ladders that classify rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import between, finite, percent_or_infinite

# ---- residue selections


def chain(value: str) -> Column:
    """Matches the label or the author chain; false, not null, where both are missing."""
    return F.coalesce(F.col("label_asym_id") == value, F.lit(False)) | F.coalesce(F.col("auth_asym_id") == value, F.lit(False))


def resi(low: int, high: int | None = None) -> Column:
    """A residue number or an inclusive range, in either order, of the label or the author numbering."""
    low, high = sorted((low, low if high is None else high))
    return between(F.col("label_seq_id").cast("double"), low, high) | between(F.col("auth_seq_id").cast("double"), low, high)


def atom(value: str) -> Column:
    return F.coalesce(F.col("label_atom_id") == value, F.lit(False))


def element(value: str) -> Column:
    return F.coalesce(F.col("type_symbol") == value, F.lit(False))


def _leaf(field: str, value: str) -> str:
    """The SQL condition of one clause."""
    quoted = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if field == "resi":
        m = re.fullmatch(r"(-?\d+)(?::(-?\d+))?", value)
        if not m:
            raise ValueError(f'bad resi range "{value}" (want INT or LO:HI)')
        low, high = sorted((int(m[1]), int(m[2] or m[1])))
        return f"(coalesce(label_seq_id BETWEEN {low} AND {high}, false) OR coalesce(auth_seq_id BETWEEN {low} AND {high}, false))"
    columns = {"chain": ("label_asym_id", "auth_asym_id"), "atom": ("label_atom_id",), "element": ("type_symbol",)}[field]
    return "(" + " OR ".join(f"coalesce({c} = {quoted}, false)" for c in columns) + ")"


def residue_filter(text: str) -> Column:
    """`chain A and (resi 10:20 or resi 30) and not atom H` as a Column.

    Each clause becomes a SQL condition; and, or, not and parentheses are Spark SQL's own.  ValueError for what is neither."""
    words = re.findall(r"[()]|[^\s()]+", text)
    out: list[str] = []
    k, open_ = 0, True  # open_: a clause has to follow
    while k < len(words):
        w = words[k].lower()
        if open_ == (w in ("and", "or", ")")):
            raise ValueError(f'unexpected "{words[k]}"')
        open_ = w in ("and", "or", "not", "(")
        if w in ("and", "or", "not", "(", ")"):
            out.append(w.upper())
            k += 1
        elif w in ("chain", "resi", "atom", "element"):
            if k + 1 == len(words) or words[k + 1].lower() in ("and", "or", "not", "(", ")"):
                raise ValueError(f'"{w}" needs a value')
            out.append(_leaf(w, words[k + 1]))
            k += 2
        else:
            raise ValueError(f'unknown field "{words[k]}" (want chain|resi|atom|element)')
    if not out:
        raise ValueError('empty query (want e.g. "chain A and resi 10:20")')
    if open_:
        raise ValueError("the query ends where a clause has to follow")
    return F.expr(" ".join(out))


def residues_of(atoms: DataFrame, where: Column) -> DataFrame:
    """Residues with a selected atom, and how many of it."""
    return atoms.filter(where).groupBy("label_asym_id", "label_seq_id").agg(F.count("*").alias("n_atoms"))


# ---- worklist


def haystack(*fields: str) -> Column:
    """The fields that are neither null nor empty, space-joined, in lower case."""
    return F.lower(F.concat_ws(" ", *(F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields)))


def matches_text(hay: Column, text: str) -> Column:
    """Every word of text occurs; an empty text matches all."""
    return reduce(lambda a, b: a & b, (hay.contains(w) for w in text.lower().split()), F.lit(True))


def filter_worklist(rows: DataFrame, text: str = "", modalities: tuple[str, ...] = (), source: str | None = None, has_seg: bool | None = None, fields: tuple[str, ...] = ("key", "modality", "series_description")) -> DataFrame:
    out = rows.filter(matches_text(haystack(*fields), text))
    if modalities:
        out = out.filter(F.col("modality").isin(*modalities))
    if source is not None:
        out = out.filter(F.col("source") == source)
    if has_seg is not None:
        out = out.filter(F.col("has_seg") == has_seg)
    return out


def order_worklist(rows: DataFrame, by: str = "key", descending: bool = False) -> DataFrame:
    """By key, voxels (missing as -1) or modality then key."""
    keys = {"key": [F.col("key")], "voxels": [F.coalesce("voxels", F.lit(-1)), F.col("key")], "modality": [F.col("modality"), F.col("key")]}[by]
    return rows.orderBy(*((k.desc() if descending else k.asc()) for k in keys))


def guess_modality(key: Column, stated: Column) -> Column:
    k = F.lower(key)
    has = lambda *words: reduce(lambda a, b: a | b, (k.contains(w) for w in words))
    return F.coalesce(F.nullif(stated, F.lit("")), F.when(has("ct", "covid", "lung"), "CT").when(has("mr", "flair", "prostate", "cardiac"), "MR").when(has("skull"), "CT").otherwise("OT"))


# ---- rows by declared transforms


@dataclass(frozen=True)
class Keep:
    field: str
    one_of: tuple | None = None
    in_range: tuple[float, float] | None = None
    negate: bool = False


@dataclass(frozen=True)
class Log:
    field: str
    base: float = 10
    new_field: str | None = None


@dataclass(frozen=True)
class Concat:
    fields: tuple[str, ...]
    new_field: str
    separator: str = " "


def apply_transforms(rows: DataFrame, steps: list[Keep | Log | Concat]) -> DataFrame:
    """Filters, logarithms and joined fields, in order.  A range never matches what is not a number."""
    for s in steps:
        if isinstance(s, Keep):
            numeric = rows.schema[s.field].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")
            hit = F.coalesce(F.col(s.field).isin(*s.one_of), F.lit(False)) if s.one_of is not None else between(F.col(s.field).cast("double"), *s.in_range) if s.in_range and numeric else F.lit(False)
            rows = rows.filter(~hit if s.negate else hit)
        elif isinstance(s, Log):
            import math

            rows = rows.withColumn(s.new_field or s.field, F.ln(F.col(s.field)) / math.log(s.base))
        else:
            rows = rows.withColumn(s.new_field, F.concat_ws(s.separator, *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in s.fields)))
    return rows


# ---- classification ladders

#: Transfer syntaxes and what is said of them.
COMPRESSION = (
    (("1.2.840.10008.1.2.1",), "none: implicit VR little endian"),
    (("1.2.840.10008.1.2",), "none: explicit VR little endian"),
    ((".1.2.4.50", ".1.2.4.51"), "lossy: JPEG baseline"),
    ((".1.2.4.70", ".1.2.4.80"), "lossless: JPEG or JPEG-LS"),
    ((".1.2.4.81", ".1.2.4.90", ".1.2.4.91"), "lossy: JPEG-LS near-lossless or JPEG 2000"),
)


def compression_verdict(uid: Column) -> Column:
    out = F.when(F.coalesce(uid, F.lit("")) == "", "unknown: no transfer syntax")
    for ends, said in COMPRESSION:
        out = out.when(reduce(lambda a, b: a | b, (uid.endswith(e) if e[0] == "." else uid == e for e in ends)), said)
    return out.otherwise(F.concat(F.lit("unknown: "), uid))


#: Tags that name a person or place, tags that are dates, private tags known to be safe, tags that always pass.
REPLACED_TAGS = ("00100010", "00100020", "00100030", "00080080", "00080081", "00081048", "00081060", "00081070", "00101060", "00400275")
DATE_TAGS = ("00080020", "00080021", "00080030", "00080031", "00100030", "00400002", "00400003")
SAFE_PRIVATE_TAGS = ("00191080", "0019100c")
PASSED_TAGS = ("0020000d", "0020000e", "00080018", "7fe00010")


def deid_action(tag: Column, keep_dates: bool = False, retain_safe_private: bool = False) -> Column:
    """replace, remove, keep or pass.  The allow-list is compared in upper case, so its entry with a hex letter never
    matches and such tags are removed: the safer side."""
    k, up = F.lower(tag), F.upper(tag)
    private = F.conv(F.substring(k, 1, 4), 16, 10).cast("bigint") % 2 == 1
    safe = up.isin(*SAFE_PRIVATE_TAGS) if retain_safe_private else F.lit(False)
    dated = F.lit("keep") if keep_dates else F.when(up.isin(*REPLACED_TAGS), "replace").otherwise("remove")
    return F.when(k.isin(*PASSED_TAGS), "pass").when(up.isin(*DATE_TAGS), dated).when(up.isin(*REPLACED_TAGS), "replace").when(private, F.when(safe, "keep").otherwise("remove")).otherwise("pass")


#: Fixed values: (protocol, modality, pattern or none, layout, preset, projection), the first that fits.
HANGING = (
    ("ct-lung", "CT", "lung|chest|thorax|covid", "axial", "CT_Lung", "slice"),
    ("ct-bone", "CT", "bone|skull|spine|pelvis|fracture", "tri", "CT_Bone", "slice"),
    ("ct-angio", "CT", "angio|aaa|vessel|cardiac", "coronal", "CT_AAA", "mip"),
    ("ct-default", "CT", None, "tri", "CT_SoftTissue", "slice"),
    ("mr-brain", "MR", "brain|brats|tumor|flair|t1|t2", "tri", "auto", "slice"),
    ("mr-default", "MR", None, "tri", "auto", "slice"),
    ("mg-tomo", "MG", None, "coronal", "auto", "slice"),
)


def hanging_protocol(modality: Column, description: Column) -> Column:
    """struct(protocol, layout, preset, projection)."""
    choice = lambda p, layout, preset, projection: F.struct(F.lit(p).alias("protocol"), F.lit(layout).alias("layout"), F.lit(preset).alias("preset"), F.lit(projection).alias("projection"))
    out = choice("default", "tri", "auto", "slice")
    for p, m, pattern, *rest in reversed(HANGING):
        fits = F.upper(F.coalesce(modality, F.lit(""))) == m
        if pattern:
            fits = fits & F.coalesce(description, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(fits, choice(p, *rest)).otherwise(out)
    return out


def lung_rads(solid: Column, part_solid: Column, ground_glass: Column, suspicious: Column) -> Column:
    return (
        F.when(suspicious, "4X").when(part_solid >= 6, "4B").when(solid >= 8, "4A").when((solid >= 6) | (ground_glass >= 30), "3").when((solid >= 4) | (part_solid >= 4) | (ground_glass >= 20), "2").otherwise("1")
    )


def bi_rads(mass: Column, suspicious_mass: Column, suspicious_calcs: Column, distortion: Column) -> Column:
    return F.when(suspicious_mass & (suspicious_calcs | distortion), "5").when(suspicious_mass | suspicious_calcs, "4C").when(mass | distortion, "4A").otherwise("2")


def recist(baseline: Column, nadir: Column, current: Column, new_lesion: Column) -> Column:
    """PD, CR, PR or SD from sums of long axes."""
    from_base, from_nadir = percent_or_infinite(baseline, current), percent_or_infinite(nadir, current)
    return F.when(new_lesion | ((from_nadir >= 20) & (current - nadir >= 5)), "PD").when(current == 0, "CR").when(from_base <= -30, "PR").otherwise("SD")


def recorded(x: Column) -> Column:
    """A dose number that is finite and not negative, else null."""
    return F.when(finite(x) & (x >= 0), x)


def orientation_problem(dims: list[Column], spacing: list[Column], least_slices: int = 2) -> Column:
    """The first problem, or the empty string."""
    out = F.when(F.lit(False), "")
    for a in range(3):
        out = out.when(~finite(dims[a].cast("double")) | (dims[a] <= 0), F.format_string(f"bad dims[{a}]: %s", dims[a].cast("string")))
        out = out.when(~finite(spacing[a].cast("double")) | (spacing[a] <= 0), F.format_string(f"bad spacing[{a}]: %s", spacing[a].cast("string")))
    return out.when(dims[2] < least_slices, F.format_string("only %s axial slice(s)", dims[2].cast("string"))).otherwise("")


def inside_box(x: Column, y: Column, z: Column, box: tuple[tuple[float, float], ...], plane: tuple[float, float, float, float] | None = None) -> Column:
    """In the box and on the positive side of the plane (normal and offset)."""
    out = between(x, *box[0]) & between(y, *box[1]) & between(z, *box[2])
    return out & (plane[0] * x + plane[1] * y + plane[2] * z >= plane[3]) if plane else out


#: Format by the end of a file's name, longer ends first.
NAME_ENDS = ((".ome.tiff", "ome-tiff"), (".ome.tif", "ome-tiff"), (".ome.zarr", "ome-zarr"), (".nii.gz", "nifti"), (".nii", "nifti"), (".nrrd", "nrrd"), (".nhdr", "nrrd"), (".dcm", "dicom"), (".tiff", "tiff"), (".tif", "tiff"), (".vcf", "vcf"), (".bed", "bed"), (".gff3", "gff"), (".gff", "gff"), (".gtf", "gtf"), (".fasta", "fasta"), (".fa", "fasta"), (".pdb", "pdb"), (".cif", "mmcif"), (".csv", "csv"), (".json", "json"))


def format_by_name(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda out, e: F.when(low.endswith(e[0]), e[1]).otherwise(out), reversed(NAME_ENDS), F.lit("unknown"))


def find_structures(parts: DataFrame, concepts: DataFrame, query: str) -> DataFrame:
    """Parts (element, name, concept) that a search text means, by the first rule that finds any: element id, concept id,
    concept of that name, part of that name, part names that contain it, element ids that contain it.

    concepts: concept, name, members.  rule says which; a blank text finds nothing.  All rules run in one pass over parts:
    each part gets its best rule, and the best of all parts is one row."""
    q = query.strip().lower()
    if not q:
        return parts.withColumn("rule", F.lit(0)).filter(F.lit(False))
    wanted = concepts.filter((F.lower("concept") == q) | (F.lower("name") == q)).select(F.explode("members").alias("_m"), F.when(F.lower("concept") == q, 2).otherwise(3).alias("_r"))
    named = parts.join(wanted.groupBy(F.col("_m")).agg(F.min("_r").alias("_r")), F.col("element") == F.col("_m"), "left")
    own = F.when(F.lower("element") == q, 1).when(F.lower("concept") == q, 2).when(F.lower("name") == q, 4).when(F.lower("name").contains(q), 5).when(F.lower("element").contains(q), 6)
    ruled = named.withColumn("rule", F.least(own, F.col("_r"))).filter("rule is not null").drop("_m", "_r")
    best = ruled.agg(F.min("rule").alias("_best"))
    return ruled.join(F.broadcast(best), F.col("rule") == F.col("_best"), "left_semi")

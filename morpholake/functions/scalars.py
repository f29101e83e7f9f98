"""Scalar functions: strings, scales, geometry, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up

FOLLOW_UP = r"\s+(—|-|\(FU\)|FU\d*)\s*.*$"


def base_label(label: Column) -> Column:
    """A lesion's label without its follow-up suffix; the label itself where nothing would be left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(label, FOLLOW_UP, "")), F.lit("")), label)


def locus(text: Column) -> Column:
    """`chr1:1,000-2,000` (1-based) as struct(chrom, start, end) with a 0-based start; null if it is none."""
    part = lambda k: F.regexp_extract(text, r"^\s*([^:\s]+):([\d,]+)-([\d,]+)\s*$", k)
    number = lambda k: F.regexp_replace(part(k), ",", "").try_cast("bigint")
    start, end = number(2) - 1, number(3)
    return F.when((start >= 0) & (end > start), F.struct(part(1).alias("chrom"), start.alias("start"), end.alias("end")))


def locus_text(chrom: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", chrom, start + 1, end)


def loci_overlap(chrom_a: Column, start_a: Column, end_a: Column, chrom_b: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open intervals on one chromosome that share a base."""
    return (chrom_a == chrom_b) & (start_a < end_b) & (start_b < end_a)


def bases_per_pixel(start: Column, end: Column, width: Column) -> Column:
    return (end - start) / F.greatest(F.lit(1), width)


def to_pixels(position: Column, start: Column, per_pixel: Column) -> Column:
    return (position - start) / per_pixel


def to_base(pixel: Column, start: Column, per_pixel: Column) -> Column:
    return F.floor(start + pixel * per_pixel)


def date_text(raw: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else as it is."""
    return F.when(raw.rlike(r"^\d{8}$"), F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(raw)


def time_text(raw: Column) -> Column:
    """HHMMSS... as HH:MM:SS; anything else as it is."""
    return F.when(raw.rlike(r"^\d{6}"), F.regexp_replace(raw, r"^(\d{2})(\d{2})(\d{2}).*$", "$1:$2:$3")).otherwise(raw)


def window_level(value: Column, width: Column | float, center: Column | float) -> Column:
    """0 to 255 across the window around the center, clamped."""
    low = F.lit(center) - F.lit(width) / 2
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - low) / F.lit(width) * 255))


def window_of_range(low: Column, high: Column) -> tuple[Column, Column]:
    """(width, center); the width is 1 at least."""
    return F.greatest(F.lit(1.0), high - low), (low + high) / 2


def slope_intercept(raw: Column, bits: int, signed: bool, slope: Column | float, intercept: Column | float) -> Column:
    """Masks raw to its stored bits, extends the sign, and rescales."""
    masked = raw.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    value = F.when(masked >= (1 << (bits - 1)), masked - (1 << bits)).otherwise(masked) if signed else masked
    return value * F.lit(slope) + F.lit(intercept)


def segment_length(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column, spacing: tuple[float, float, float]) -> Column:
    return F.sqrt(F.pow((ax - bx) * spacing[0], 2) + F.pow((ay - by) * spacing[1], 2) + F.pow((az - bz) * spacing[2], 2))


def angle_degrees(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Between two vectors; null if one has no length."""
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm)))))


def ellipse_area(rx: Column, ry: Column, sx: float, sy: float) -> Column:
    import math

    return F.lit(math.pi) * rx * sx * ry * sy


def doubling_time(v1: Column, v2: Column, days: Column) -> Column:
    """Days for a volume to double; infinite without growth, null where a volume or the interval is not positive."""
    grown = days * F.ln(F.lit(2.0)) / F.ln(v2 / v1)
    return F.when((v1 > 0) & (v2 > 0) & (days > 0), F.when(v2 <= v1, F.lit(float("inf"))).otherwise(grown))


def tag_key(group: Column, element: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(group), 4, "0"), F.lpad(F.hex(element), 4, "0")))


def bytes_text(n: Column) -> Column:
    """1.5 MB and the like; a dash for null.  Halves go to the even digit, as in C: Java's own format would take them up."""
    return (
        F.when(n.isNull(), "—")
        .when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024.0**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(n / 1024.0**3, 1)))
    )


def escape_html(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fnv1a(s: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(s, "UTF-8")), "(?<=\\G..)"), lambda b: b != ""), lambda b: F.conv(b, 16, 10).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda a, b: (a.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def attributes(s: Column, dialect: str = "gff3") -> Column:
    """Column nine of GFF3 (`k=v;`) or GTF (`k "v";`) as a map; of equal keys the last one counts."""
    pattern = r"^\s*([^=\s]+)\s*=\s*(.*?)\s*$" if dialect == "gff3" else r"^\s*(\S+)\s+\"?(.*?)\"?\s*$"
    pairs = F.filter(F.split(s, ";"), lambda p: p.rlike(pattern))
    value = lambda p: F.regexp_replace(F.regexp_extract(p, pattern, 2), r"^\"|\"$", "")
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, pattern, 1).alias("key"), (F.try_url_decode(F.replace(value(p), F.lit("+"), F.lit("%2B"))) if dialect == "gff3" else value(p)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def affine(m: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A 3x4 matrix, row by row, applied to a point."""
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))  # type: ignore[return-value]


def compose_affine(a: list[float], b: list[float]) -> list[float]:
    """First b, then a."""
    out = []
    for r in range(3):
        for c in range(4):
            out.append(sum(a[4 * r + k] * b[4 * k + c] for k in range(3)) + (a[4 * r + 3] if c == 3 else 0.0))
    return out


def ramp(stops: list[tuple[float, float]], v: Column) -> Column:
    """Linear interpolation over (position, value) stops in ascending order; flat beyond the ends; null without stops."""
    if not stops:
        return F.lit(None).cast("double")
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        part = F.lit(float(y0)) + (v - x0) / (x1 - x0 or 1.0) * (y1 - y0)
        out = F.when(v < x1, part).otherwise(out)
    return F.when(v <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def tercile(fraction: Column) -> Column:
    return F.least(F.lit(2), F.greatest(F.lit(0), F.floor(fraction * 3)))


def rounded_key(*numbers: Column, digits: int = 3) -> Column:
    return F.concat_ws("|", *(F.format_string(f"%.{digits}f", half_up(x, digits)) for x in numbers))


def luma_of_ybr(y: Column, blue: Column, red: Column) -> Column:
    """Brightness of a colour given as brightness and two differences (0 to 255), by way of its clamped primaries."""
    clamp = lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)))
    r, g, b = clamp(y - 179.456 + 1.402 * red), clamp(y + 135.459 - 0.344 * blue - 0.714 * red), clamp(y - 226.816 + 1.772 * blue)
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def series_key(description: Column, uid: Column, number: Column, orientation: Column, cols: Column, rows: Column) -> Column:
    """What groups files into a series; what is missing is empty, sizes 0."""
    size = F.concat(F.coalesce(cols, F.lit(0)).cast("string"), F.lit("x"), F.coalesce(rows, F.lit(0)).cast("string"))
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (description, uid, number, orientation)), size)


def number_text(x: Column) -> Column:
    """A number as a key's part: whole ones without a point, nan where it is none."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "nan").when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def view_key(series: Column, plane: Column, index: Column, width: Column, center: Column, invert: Column, frame: Column) -> Column:
    """One key for what determines a picture of a slice."""
    return F.concat_ws("|", series, plane, index.cast("string"), F.concat(F.lit("W"), number_text(width), F.lit("C"), number_text(center)), F.when(invert, "inv").otherwise("nrm"), F.concat(F.lit("t"), F.coalesce(frame, F.lit(0)).cast("string")))

"""Checks and masking: findings as rows, identities replaced, versions compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite

#: Transfer syntaxes whose pixels can be read, and those that are compressed.
PLAIN_SYNTAXES = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99")
CODED_SYNTAXES = ("1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70")
#: Storage classes by family.
SOP_FAMILIES = {
    "rt_plan": ("1.2.840.10008.5.1.4.1.1.481.5",),
    "rt_dose": ("1.2.840.10008.5.1.4.1.1.481.2",),
    "us": ("1.2.840.10008.5.1.4.1.1.6.1", "1.2.840.10008.5.1.4.1.1.3.1"),
    "tomo": ("1.2.840.10008.5.1.4.1.1.13.1.3",),
    "encapsulated": ("1.2.840.10008.5.1.4.1.1.104.1", "1.2.840.10008.5.1.4.1.1.104.2"),
}


#: A volume whose largest spacing is more than so many times its smallest is stretched when cut anew.
ANISOTROPIC = 5


def volume_problems(volumes: DataFrame, key: str) -> DataFrame:
    """key, level, code: one row per problem of a volume (nx, ny, nz, sx, sy, sz, n_values, n_nonfinite).

    Errors: bad-dims, bad-spacing, length-mismatch, all-nonfinite; warnings: anisotropic, some-nonfinite.  A null size or
    spacing is bad; n_nonfinite counts NaN and infinities among the n_values."""
    dims, spacing = [F.col(f"n{a}").cast("bigint") for a in "xyz"], [F.col(f"s{a}") for a in "xyz"]
    every = lambda conditions: reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))
    sound = every(finite(s) & (s > 0) for s in spacing)
    product = dims[0] * dims[1] * dims[2]
    n, bad = F.col("n_values"), F.col("n_nonfinite")
    found = [
        ("error", "bad-dims", ~every(n > 0 for n in dims)),
        ("error", "bad-spacing", ~sound),
        ("error", "length-mismatch", (product > 0) & (n != product)),
        ("warn", "anisotropic", sound & (F.greatest(*spacing) / F.least(*spacing) > ANISOTROPIC)),
        ("error", "all-nonfinite", (n > 0) & (bad == n)),
        ("warn", "some-nonfinite", (bad > 0) & (bad < n)),
    ]
    rows = F.array_compact(F.array(*(F.when(is_, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, is_ in found)))
    return volumes.select(key, F.explode(rows).alias("p")).select(key, "p.level", "p.code")


def unlicensed(records: DataFrame, license_column: str = "license") -> DataFrame:
    """Records without a known license: null, empty or UNVERIFIED."""
    return records.filter(F.coalesce(F.col(license_column), F.lit("")).isin("", "UNVERIFIED"))


def bad_terms(terms: DataFrame) -> DataFrame:
    """term, reason: the first fault of each row of a term table (term, name, parent, members): term-id, name, parent or members.

    A term is FMA and digits, a name not empty, a parent null or not empty, members an array without null or empty names."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(F.col("term").rlike(r"^FMA\d+$"), F.lit(False)), "term-id")
        .when(empty(F.col("name")), "name")
        .when(F.col("parent") == "", "parent")
        .when(F.col("members").isNull() | F.exists("members", empty), "members")
    )
    return terms.select("term", reason.alias("reason")).filter("reason is not null")


def axis_findings(planes: DataFrame, by: str) -> DataFrame:
    """Per image three findings with ok: every (t, c, z) once, none missing, one size throughout."""
    size = lambda a: F.max(a) + 1
    sums = planes.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("t", "c", "z").alias("d"), (size("t") * size("c") * size("z")).alias("all"), F.count_distinct("width", "height").alias("sizes"))
    rows = F.array(*(F.struct(F.lit(name).alias("finding"), ok.alias("ok")) for name, ok in (("unique", F.col("n") == F.col("d")), ("complete", F.col("d") == F.col("all")), ("one_size", F.col("sizes") == 1))))
    return sums.select(by, F.explode(rows).alias("f")).select(by, "f.finding", "f.ok")


def anonymize(records: DataFrame, root: str = "2.25", keep_dates: bool = False, names: tuple[str, ...] = ("patient_name", "patient_id"), uids: tuple[str, ...] = ("study_uid",), dates: tuple[str, ...] = ("study_date",)) -> DataFrame:
    """Fixed names and ids, UIDs under another root by a digest (equal ones stay equal), dates kept or emptied."""
    out = {c: F.when(F.col(c).isNotNull(), F.lit("ANON")) for c in names if c in records.columns}
    out |= {c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{root}."), F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10))) for c in uids if c in records.columns}
    out |= {c: F.lit(None).cast("string") for c in dates if c in records.columns and not keep_dates}
    return records.withColumns(out)


def clip_rectangle(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) of the part inside an image; null where there is none."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def readable_syntax(uid: Column) -> Column:
    """Whether the pixels of a transfer syntax can be read here: those that are plain, run lengths, JPEG baseline and lossless."""
    return F.coalesce(uid.isin(*PLAIN_SYNTAXES, *CODED_SYNTAXES), F.lit(False))


def checked_syntax(uid: Column) -> Column:
    """uid where its pixels can be read; else an error that names it."""
    return F.when(readable_syntax(uid), uid).otherwise(F.raise_error(F.concat(F.lit("transfer-syntax: "), F.coalesce(uid, F.lit("none")))).cast("string"))


def sop_family(uid: Column) -> Column:
    return reduce(lambda out, kv: F.when(uid.isin(*kv[1]), kv[0]).otherwise(out), SOP_FAMILIES.items(), F.lit("other"))


def differing_fields(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, field: the fields in which two versions of a record differ, and rows that one side lacks as field `missing`."""
    fields = [c for c in a.columns if c != key]
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    lost = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.when(lost, F.array(F.lit("missing"))).otherwise(changed)).alias("field"))


def grade(cases: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """agree and difference of a measured sum and a picked category against the published ones."""
    diff = F.col("measured_sum") - F.col("published_sum")
    return cases.withColumn("difference", diff).withColumn("agree", (F.abs(diff) <= tolerance) & F.col("picked").eqNullSafe(F.col("published")))

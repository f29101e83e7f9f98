"""Readouts and small projections: probes, picks near annotations, records, audit trails, channels, passes, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .quality import sop_family


def probe(points: DataFrame, voxels: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """points (by, point_id, px, py, pz) with v of the nearest voxel, null outside: an equi-join on rounded places."""
    at = points.withColumns({f"_{c}": half_up(F.col(f"p{c}"), 0).cast("bigint") for c in "xyz"})
    own = voxels.select(*by, *(F.col(c).cast("bigint").alias(f"_{c}") for c in "xyz"), "v")
    return at.join(own, [*by, "_x", "_y", "_z"], "left").drop("_x", "_y", "_z")


def segment_distance(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of a point to a segment in the plane; a segment without length is its point."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length)))
    return F.sqrt(F.pow(a[0] + t * dx - p[0], 2) + F.pow(a[1] + t * dy - p[1], 2))


def near_annotation(proximity: float, points: str = "points", u: str = "u", v: str = "v") -> Column:
    """Whether (u, v) lies within proximity of a segment between neighbours of points (array of u, v), or of its only point.

    Locked or invisible annotations (columns locked, visible) are never near; one without points raises."""
    if not proximity > 0:
        raise ValueError(f"annotation-proximity: {proximity}")
    p = F.col(u), F.col(v)
    at = lambda i: (F.get(points, i)["u"], F.get(points, i)["v"])
    first = F.when(F.size(points) == 1, F.sequence(F.lit(0), F.lit(0))).otherwise(F.sequence(F.lit(1), F.size(points) - 1))
    near = F.exists(first, lambda i: segment_distance(p, at(F.greatest(F.lit(0), i - 1)), at(i)) <= proximity)
    some = F.when(F.size(points) > 0, near).otherwise(F.raise_error(F.lit("annotation-handles")).cast("boolean"))
    return ~F.col("locked") & F.col("visible") & some


def label_masks(labels: DataFrame) -> DataFrame:
    """A row per voxel of each label's mask: label 0 is no label."""
    return labels.filter(F.col("label") != 0)


def audit_for(events: DataFrame, series: object = None, name: str = "series") -> DataFrame:
    """The events of one series, or all where none is given, oldest first."""
    rows = events if series is None or series == "" else events.filter(F.col(name) == series)
    return rows.orderBy("ts", "event_id")


def difficulty_range(cases: Column) -> Column:
    """struct(low, high) of an array of cases with a difficulty."""
    of = F.transform(cases, lambda c: c["difficulty"])
    return F.struct(F.array_min(of).alias("low"), F.array_max(of).alias("high"))


def rotate_points(points: DataFrame, orbit: float, tilt: float, by: list[str]) -> DataFrame:
    """Points turned about the centre of their group: around y by orbit, then around x by tilt."""
    centre = points.groupBy(*by).agg(*(F.avg(c).alias(f"_m{c}") for c in "xyz"))
    x, y, z = (F.col(c) - F.col(f"_m{c}") for c in "xyz")
    co, so, ct, st = F.cos(F.lit(orbit)), F.sin(F.lit(orbit)), F.cos(F.lit(tilt)), F.sin(F.lit(tilt))
    turned = {"x": x * co + z * so, "y": y * ct - (z * co - x * so) * st, "z": y * st + (z * co - x * so) * ct}
    return points.join(centre, by).withColumns({c: turned[c] + F.col(f"_m{c}") for c in "xyz"}).drop("_mx", "_my", "_mz")


def composite(channels: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """by, r, g, b (0 to 255): channels (by, channel, v) laid over each other by limits (channel, low, high, r, g, b).

    A value's place between its channel's limits weighs the channel's colour; a span is 0.0005 at least."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("low")) / F.greatest(F.lit(0.0005), F.col("high") - F.col("low"))))
    lit = channels.join(limits, "channel").withColumn("_k", share)
    return lit.groupBy(*by).agg(*(F.least(F.lit(255), half_up(F.sum(F.col("_k") * F.col(c) / 255) * 255, 0)).cast("int").alias(c) for c in "rgb"))


def pass_means(passes: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """mean: of each pixel over the passes so far; a pixel has a few passes, so its window is small."""
    from pyspark.sql import Window

    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return passes.withColumn("mean", half_up(F.avg(value).over(upto), 0))


def routed(files: DataFrame, uid: str = "sop_class") -> dict[str, DataFrame]:
    """The files of each kind of object, by their class: one projection, a filter per branch."""
    marked = files.withColumn("route", sop_family(F.col(uid)))
    return {kind: marked.filter(F.col("route") == kind).drop("route") for kind in ("rt_plan", "rt_dose", "us", "other")}


def records(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """A worklist row per entry (key, img, seg, dicom: arrays of files), with what its header (key, ...) and sizes tell.

    Without a header its fields are null; voxels is the product of dims where these are known."""
    files = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("img", "seg", "dicom")))
    rows = entries.select("key", files.alias("files"), (F.coalesce(F.size("seg"), F.lit(0)) > 0).alias("has_seg"), F.when(F.size("dicom") > 0, "dicom").otherwise("nifti").alias("source"))
    filled = rows.join(headers, "key", "left")
    voxels = F.aggregate("dims", F.lit(1).cast("bigint"), lambda a, d: a * d)
    return filled.withColumn("voxels", F.when(F.col("dims").isNotNull(), voxels))

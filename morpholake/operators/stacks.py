"""Image frames to stacks: grouped by geometry, ordered along the normal, repeated positions told apart as phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rounded_key
from .ordered import anchored_clusters

#: Positions nearer than this are one; gaps may differ by so much, absolutely or as a share of the median.
SAME_POSITION = 0.01
GAP_TOLERANCE = 0.01
GAP_SHARE = 0.01


def geometry_key() -> Column:
    """Series, matrix, orientation and spacing, to three digits."""
    numbers = lambda c: F.array_join(F.transform(c, lambda x: rounded_key(x)), ",")
    return F.concat_ws("|", F.coalesce("series_uid", F.lit("no-series")), F.format_string("%dx%d", "cols", "rows"), F.coalesce(numbers(F.col("iop")), F.lit("no-iop")), F.coalesce(numbers(F.col("pixel_spacing")), F.lit("no-ps")))


def along_normal() -> Column:
    """Position along the cross product of the row and column directions; null without position or orientation."""
    i = lambda k: F.get("iop", k)
    n = [i(1) * i(5) - i(2) * i(4), i(2) * i(3) - i(0) * i(5), i(0) * i(4) - i(1) * i(3)]
    size = F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    return F.when(size > 0, sum((F.get("ipp", k) * n[k] for k in range(3)), F.lit(0.0)) / size)


def stacks(frames: DataFrame) -> DataFrame:
    """(row_no, stack, phase, place, warning) for frames (row_no, series_uid, cols, rows, iop, ipp, pixel_spacing,
    instance_number, frame_index).

    Frames of one geometry key are sorted along the normal and clustered by position.  Where every position repeats
    equally often, the repeats are phases, each a stack; where they repeat unevenly, the first of each position stays, with
    the warning duplicate-position.  A geometry with a frame without position is ordered by acquisition, with the warning
    no-position."""
    keyed = frames.withColumn("geometry", geometry_key()).withColumn("d", along_normal())
    known = keyed.withColumn("placed", F.count(F.when(F.col("d").isNull(), 1)).over(Window.partitionBy("geometry")) == 0)
    order = [F.coalesce("instance_number", F.lit(0)), F.coalesce("frame_index", F.lit(0)), F.col("row_no")]
    clustered = anchored_clusters(known.filter("placed").select("geometry", F.col("row_no").cast("bigint").alias("row_no"), "d"), ["geometry"], "d", SAME_POSITION).drop("phase")
    placed = known.filter("placed").join(clustered.drop("geometry"), "row_no")
    placed = placed.withColumn("phase", F.row_number().over(Window.partitionBy("geometry", "cluster").orderBy(*order)) - 1)
    sizes = placed.groupBy("geometry", "cluster").agg(F.count("*").alias("n")).groupBy("geometry").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("clusters"))
    joined = placed.join(sizes, "geometry")
    even = (F.col("least") == F.col("most")) & (F.col("clusters") > 1)
    spatial = joined.filter(even | (F.col("phase") == 0)).select(
        "row_no", F.concat_ws("#", "geometry", F.when(even & (F.col("most") > 1), F.col("phase").cast("string"))).alias("stack"), F.when(even & (F.col("most") > 1), F.col("phase")).alias("phase"), F.col("cluster").alias("place"), F.when(~even & (F.col("most") > 1), "duplicate-position").alias("warning")
    )
    free = known.filter("not placed").withColumn("place", F.row_number().over(Window.partitionBy("geometry").orderBy(*order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy("geometry")))
    return spatial.unionByName(free.select("row_no", F.col("geometry").alias("stack"), F.lit(None).cast("int").alias("phase"), "place", F.when(F.col("n") > 1, "no-position").alias("warning")))


def spacing(stacked: DataFrame, frames: DataFrame) -> DataFrame:
    """stack, slices, spacing (upper median gap) and uniform (gaps within tolerance), for stacks of two slices or more."""
    d = stacked.join(frames.select(F.col("row_no").cast("bigint").alias("row_no"), along_normal().alias("d")), "row_no")
    gaps = d.withColumn("gap", F.col("d") - F.lag("d").over(Window.partitionBy("stack").orderBy("place"))).filter("gap is not null")
    sums = gaps.groupBy("stack").agg((F.count("*") + 1).alias("slices"), F.array_sort(F.collect_list("gap")).alias("g"))
    median = F.get("g", F.floor(F.size("g") / 2).cast("int"))
    return sums.select("stack", "slices", median.alias("spacing"), (F.array_max("g") - F.array_min("g") <= F.greatest(F.lit(GAP_TOLERANCE), GAP_SHARE * median)).alias("uniform"))

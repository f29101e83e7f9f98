"""Aggregations: histograms and what is read off them, channel statistics, normalisation, registries, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .filters import compression_verdict, recorded
from .running import percentile, ranked_counts


def joined_back(rows: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """rows with their group's sums: one row per group comes back, so Spark can broadcast it when it is small."""
    return rows.join(sums, by)


def volume_stats(voxels: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    return voxels.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def histogram(voxels: DataFrame, by: list[str], v: str = "v", bins: int = 256) -> DataFrame:
    """by, bin, n: equal bins from the least to the largest value, the largest in the last one; a span of 0 counts as 1.

    Two scans with partial aggregation each: bounds, then counts; only bins x groups rows are shuffled."""
    bounds = voxels.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    at = F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col("lo")) / span * bins)).cast("int")
    return joined_back(voxels.filter(F.col(v).isNotNull()), bounds, by).groupBy(*by, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))


def depth_histogram(values: DataFrame, by: list[str], v: str, bins: int, top: float) -> DataFrame:
    """by, bin, n of the values that are not null, from 0 to top; what is over top is in the last bin."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(v) / top * bins)).cast("int")
    return values.filter(F.col(v).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantile(hist: DataFrame, by: list[str], q: float, name: str, bins: int = 256, skip_full_first: bool = False) -> DataFrame:
    """by and the centre of the first bin at which the counts so far reach q.

    skip_full_first leaves out bin 0 where it holds over a fifth, but not all, of the values.  hist: histogram()'s rows, bins
    at most per group, so the window holds little."""
    group = Window.partitionBy(*by)
    counted = hist.withColumn("_all", F.sum("n").over(group)).withColumn("_first", F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).over(group))
    if skip_full_first:
        counted = counted.filter(~((F.col("bin") == 0) & (F.col("_first") > F.col("_all") * 0.2) & (F.col("_first") < F.col("_all"))))
    counted = counted.withColumn("_total", F.sum("n").over(group)).withColumn("_sum", F.sum("n").over(group.orderBy("bin")))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    reached = counted.filter(F.col("_sum") / F.col("_total") >= q).groupBy(*by, "lo", "hi").agg(F.min("bin").alias("_bin"))
    return reached.select(*by, (F.col("lo") + (F.col("_bin") + 0.5) / bins * span).alias(name))


def auto_window(voxels: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, width, center: from the 2nd to the 98th percentile of the histogram."""
    hist = histogram(voxels, by, v)
    low, high = histogram_quantile(hist, by, 0.02, "low", skip_full_first=True), histogram_quantile(hist, by, 0.98, "high", skip_full_first=True)
    return low.join(high, by).select(*by, F.greatest(F.lit(1.0), F.col("high") - F.col("low")).alias("width"), ((F.col("low") + F.col("high")) / 2).alias("center"))


def otsu(hist: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """by and threshold: the bin centre that best splits the histogram in two (largest variance between; the first on ties)."""
    group = Window.partitionBy(*by)
    order = group.orderBy("bin")
    i, n = F.col("bin").cast("double"), F.col("n")
    cut = hist.withColumn("wb", F.sum(n).over(order)).withColumn("sb", F.sum(i * n).over(order)).withColumn("w", F.sum(n).over(group)).withColumn("s", F.sum(i * n).over(group))
    wf = F.col("w") - F.col("wb")
    means = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.when(wf > 0, wf)
    between = F.col("wb") * wf * means * means
    best = cut.filter(wf > 0).groupBy(*by, "lo", "hi").agg(F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("k"))).alias("m"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return best.select(*by, (F.col("lo") + (-F.col("m.k") + 0.5) / bins * span).alias("threshold"))


def channel_stats(values: DataFrame, by: str, v: str = "v") -> DataFrame:
    """min, max and mean of all values; sd, quartiles and contrast limits of those that are not 0.

    A quantile p is the value at index min(n - 1, floor(p n)) of the sorted values; sd is around the mean of all values.
    Values are counted first; the running count over them spreads a channel over partitions."""
    sums = values.groupBy(by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    ranked = ranked_counts(values.filter(F.col(v) != 0), [by], v)

    def at(p: float, name: str) -> Column:
        index = F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
        return F.min(F.when(F.col("upto") > index, F.col("x"))).alias(name)

    quantiles = ranked.groupBy(by).agg(at(0.5, "median"), at(0.25, "q1"), at(0.75, "q3"), at(0.0005, "low"), at(0.9995, "high"), F.sum("c").alias("nonzero"))
    spread = ranked.join(sums.select(by, "mean"), by).groupBy(by).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("mean"), 2) * F.col("c")) / F.sum("c")).alias("sd"))
    return sums.join(quantiles, by, "left").join(spread, by, "left").withColumn("sd", F.when(F.col("nonzero") > 1, F.col("sd")).otherwise(0.0))


def region_stats(voxels: DataFrame, by: list[str], inside: Column, v: str = "v") -> DataFrame:
    """n, min, max, mean and population sd of the voxels inside."""
    return voxels.filter(inside).groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def in_rectangle(u: Column, v: Column, u0: float, v0: float, u1: float, v1: float) -> Column:
    return u.between(min(u0, u1), max(u0, u1)) & v.between(min(v0, v1), max(v0, v1))


def in_ellipse(u: Column, v: Column, cu: float, cv: float, ru: float, rv: float) -> Column:
    return F.pow((u - cu) / ru, 2) + F.pow((v - cv) / rv, 2) <= 1


def rescale(values: DataFrame, by: str, v: str = "v", low: float = 0.0, high: float = 1.0, p_low: float = 0.0, p_high: float = 1.0) -> DataFrame:
    """Clips to two percentiles (linear interpolation) and maps them to low and high; null in a group without spread."""
    ends = percentile(values, [by], v, _a=p_low, _b=p_high)
    clipped = F.least(F.greatest(F.col(v), F.col("_a")), F.col("_b"))
    scaled = F.when(F.col("_b") > F.col("_a"), low + (clipped - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low))
    return joined_back(values, ends, [by]).withColumn("scaled", scaled).drop("_a", "_b")


def z_normalize(values: DataFrame, by: str, v: str = "v", mask: Column | None = None) -> DataFrame:
    """Mean and population sd of the masked values, applied to all; null where sd is 0."""
    x = F.col(v) if mask is None else F.when(mask, F.col(v))
    sums = values.groupBy(by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return joined_back(values, sums, [by]).withColumn("z", F.when(F.col("_s") > 0, (F.col(v) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def clamp(values: DataFrame, by: str, v: str = "v", low: float | None = None, high: float | None = None) -> DataFrame:
    """An open end is the group's least or largest value."""
    ends = values.groupBy(by).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    a, b = F.coalesce(F.lit(low).cast("double"), "_a"), F.coalesce(F.lit(high).cast("double"), "_b")
    return joined_back(values, ends, [by]).withColumn("clamped", F.least(F.greatest(F.col(v), a), b)).drop("_a", "_b")


def facets(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def dose_stats(grid: DataFrame, by: list[str], index: str, v: str = "v") -> DataFrame:
    """min, max, mean and the index of the largest value (the first on ties)."""
    return grid.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (-F.max(F.struct(F.col(v).alias("v"), (-F.col(index)).alias("k")))["k"]).alias("hot"))


def null_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows without a recorded number, per column; 1 for an empty table."""
    return rows.agg(*(F.coalesce(F.avg(recorded(F.col(c).cast("double")).isNull().cast("double")), F.lit(1.0)).alias(c) for c in columns))


def compression_audit(rows: DataFrame, uid: str) -> DataFrame:
    """The share of series whose compression is unknown or lossy, 3 digits; 1 for an empty table."""
    said = compression_verdict(F.col(uid))
    return rows.agg(half_up(F.coalesce(F.avg((said.startswith("unknown") | said.startswith("lossy")).cast("double")), F.lit(1.0)), 3).alias("unvalidated_rate"))


def deid_card(rows: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Rows (series, burned, replace, remove, keep) with burned_flag and ready; a share outside 0 to 1 raises."""
    burned = F.when(F.coalesce(F.col("burned").between(0, 1), F.lit(False)), F.col("burned")).otherwise(F.raise_error(F.format_string("deid-bad-fraction: %s", F.col("series").cast("string"))).cast("double"))
    flag = F.col("burned") >= threshold
    return rows.withColumn("burned", half_up(burned, 6)).withColumn("burned_flag", flag).withColumn("ready", ~flag & (F.col("remove") == 0) & (F.col("replace") >= 0))


def burned_fraction(pixels: DataFrame, by: list[str], ceiling: float, threshold: float = 0.001, v: str = "v") -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg((F.col(v) >= ceiling).cast("double")).alias("fraction")).withColumn("flagged", F.col("fraction") >= threshold)


def measurement_groups(rows: DataFrame) -> DataFrame:
    """Measurements grouped by series and label, groups numbered per series by first appearance (row_no)."""
    grouped = rows.groupBy("series", "label").agg(F.min("row_no").alias("first"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.withColumn("group_no", F.row_number().over(Window.partitionBy("series").orderBy("first")))


def block_means(pixels: DataFrame, by: list[str], factor: int, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """Means of factor x factor blocks, ragged edges over what they hold."""
    return pixels.groupBy(*by, F.floor(F.col(x) / factor).alias("block_x"), F.floor(F.col(y) / factor).alias("block_y")).agg(F.avg(v).alias("v"))


def border_median(pixels: DataFrame, by: list[str], width: int, height: int, border: int = 2, v: str = "v") -> DataFrame:
    edge = (F.col("x") < border) | (F.col("y") < border) | (F.col("x") >= width - border) | (F.col("y") >= height - border)
    return percentile(pixels.filter(edge), by, v, background=0.5)


def beads(points: DataFrame, by: list[str], k: float = 1.0) -> DataFrame:
    """Centroid, count, radius k times the cube root of the count, and first point of each group."""
    return points.groupBy(*by).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"), F.min("point_id").alias("first")).withColumn("radius", k * F.cbrt(F.col("n")))


def assembly_rollup(atoms: DataFrame) -> DataFrame:
    """Residue and chain beads from one scan of atoms: grouping sets, level 0 for residues and 1 for chains."""
    sets = atoms.groupingSets([["chain", "residue"], ["chain"]], "chain", "residue")
    return sets.agg(F.grouping("residue").cast("int").alias("level"), F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")).select("chain", "residue", "level", "n", "x", "y", "z")


def rmsd(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square distance of paired points after moving both centroids together (translation only)."""
    means = pairs.groupBy(*by).agg(*(F.avg(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"s{c}") for c in "xyz"))
    d2 = sum((F.pow(F.col(f"b{c}") - F.col(f"a{c}") - F.col(f"s{c}"), 2) for c in "xyz"), F.lit(0.0))
    return joined_back(pairs, means, by).groupBy(*by).agg(F.sqrt(F.sum(d2) / F.greatest(F.lit(1), F.count("*"))).alias("rmsd"))


def bounds(points: DataFrame, by: list[str], axes: str = "xyz") -> DataFrame:
    return points.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))))


def extents(planes: DataFrame, by: list[str], axes: tuple[str, ...] = ("t", "c", "z")) -> DataFrame:
    return planes.groupBy(*by).agg(*(F.coalesce(F.max(a) + 1, F.lit(0)).alias(f"size_{a}") for a in axes))


def profile_means(points: DataFrame, samples: int = 32) -> DataFrame:
    """bin, v: every streamline of two points or more resampled to so many points by linear interpolation, then the mean of each.

    points: line_id, k (0, 1, ... along the line), v.  A point gives the samples between it and the next one, so lines are
    read once; partial means leave the tasks."""
    if samples < 2:
        raise ValueError(f"tract-profile-samples: {samples}")
    step = F.lit(samples - 1)
    ends = points.groupBy("line_id").agg(F.max("k").alias("_last")).filter("_last >= 1")
    here = joined_back(points, ends, ["line_id"])
    # sample s lies at place s / (samples - 1) * last: each point takes part in those less than one place away
    low, high = F.greatest(F.lit(0), F.ceil((F.col("k") - 1) * step / F.col("_last"))), F.least(step, F.floor((F.col("k") + 1) * step / F.col("_last")))
    near = here.withColumn("bin", F.explode(F.sequence(low, high)))
    share = 1 - F.abs(F.col("bin") * F.col("_last") / step - F.col("k"))
    parts = near.filter(share > 0).groupBy("bin").agg(F.sum(F.col("v") * share).alias("_s"), F.sum(share).alias("_w"))
    return parts.select("bin", (F.col("_s") / F.col("_w")).alias("v"))

"""Voxel tables in long form (series, x, y, z, v): projections, stencils, morphology, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

PLANES = {"axial": ("z", ("x", "y")), "coronal": ("y", ("x", "z")), "sagittal": ("x", ("y", "z"))}
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def linear_index(nx: int, ny: int, x: str = "x", y: str = "y", z: str = "z") -> Column:
    return F.col(z) * nx * ny + F.col(y) * nx + F.col(x)


def slab(voxels: DataFrame, plane: str, center: float, thickness: float, mode: str = "max", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Projection of the slices within half the thickness of the center: max, min or mean.  The range reaches the scan."""
    axis, across = PLANES[plane]
    how = {"max": F.max, "min": F.min, "mean": F.avg}[mode]
    return voxels.filter(F.abs(F.col(axis) - center) <= thickness / 2).groupBy(*by, *across).agg(how("v").alias("v"))


def brick_ranges(voxels: DataFrame, size: int = 8, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Least and largest value of every brick with an apron of one voxel: a zone map.  NaN makes has_nan true."""
    cell = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / size).cast("bigint") for d in (-1, 0, 1))))
    out = voxels
    for c in "xyz":
        out = out.withColumn(f"brick_{c}", F.explode(F.filter(cell(c), lambda b: b >= 0)))
    v = F.when(~F.isnan("v"), F.col("v"))
    return out.groupBy(*by, "brick_x", "brick_y", "brick_z").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.bool_or(F.isnan("v")).alias("has_nan"))


def _shifted(mask: DataFrame, faces: tuple[tuple[int, int, int], ...], by: tuple[str, ...]) -> DataFrame:
    shifts = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for d, c in zip(f, "xyz", strict=True))) for f in faces))
    return mask.withColumn("_d", F.explode(shifts)).select(*by, *((F.col(c) + F.col(f"_d.d{c}")).alias(c) for c in "xyz"))


def dilate(mask: DataFrame, dims: tuple[int, int, int], by: tuple[str, ...] = ("series",)) -> DataFrame:
    """The mask (rows of set voxels) with its face neighbours inside dims."""
    grown = _shifted(mask, (*FACES, (0, 0, 0)), by).filter(F.col("x").between(0, dims[0] - 1) & F.col("y").between(0, dims[1] - 1) & F.col("z").between(0, dims[2] - 1))
    return grown.distinct()


def erode(mask: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Voxels of the mask whose six face neighbours are set; what lies outside counts as empty.

    A set voxel votes for each neighbour; one with six votes that is set itself stays.  One shuffle."""
    votes = _shifted(mask, FACES, by).withColumn("own", F.lit(0)).unionByName(mask.select(*by, "x", "y", "z").withColumn("own", F.lit(1)))
    return votes.groupBy(*by, "x", "y", "z").agg(F.max("own").alias("own"), F.sum(1 - F.col("own")).alias("votes")).filter("own = 1 and votes = 6").drop("own", "votes")


def outline(mask: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    return mask.select(*by, "x", "y", "z").join(erode(mask, by), [*by, "x", "y", "z"], "left_anti")


def morph_open(mask: DataFrame, dims: tuple[int, int, int], by: tuple[str, ...] = ("series",)) -> DataFrame:
    return dilate(erode(mask, by), dims, by)


def morph_close(mask: DataFrame, dims: tuple[int, int, int], by: tuple[str, ...] = ("series",)) -> DataFrame:
    return erode(dilate(mask, dims, by), by)


def segments_table(labels: DataFrame, voxel_volume: float, names: DataFrame) -> DataFrame:
    """value, label, voxels, volume: labels that are not 0 by value, with a name or `Segment n`."""
    counted = labels.filter("label <> 0").groupBy(F.col("label").alias("value")).agg(F.count("*").alias("voxels"))
    return counted.join(names, "value", "left").select("value", F.coalesce("name", F.format_string("Segment %d", "value")).alias("label"), "voxels", (F.col("voxels") * voxel_volume).alias("volume"))


def mask_stats(mask: DataFrame, by: list[str], spacing: tuple[float, float, float]) -> DataFrame:
    """Voxels set, their volume and their mean value."""
    return mask.filter("v is not null").groupBy(*by).agg(F.count("*").alias("voxels"), (F.count("*") * spacing[0] * spacing[1] * spacing[2]).alias("volume"), F.avg("v").alias("mean"))


def row_bands(images: DataFrame, height: str = "height", band: int = 64) -> DataFrame:
    """Bands of rows that tile each image, the last one ragged."""
    starts = images.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col(height) - 1, F.lit(band))))
    return starts.withColumn("rows", F.least(F.lit(band), F.col(height) - F.col("y0")))


def sobel(pixels: DataFrame, width: int, height: int, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Gradient magnitude of every pixel, edges repeated: a pixel sends its value with its weights to the nine it touches,
    and each sums what it gets.  One shuffle, partial sums before it."""
    moves = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    weight = lambda a, b: -a * (2 - abs(b))
    sent = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in moves))
    # A border pixel stands for its neighbours beyond the border as well.
    copies = pixels.withColumn("_cx", F.explode(F.when(F.lit(width) == 1, F.array(*(F.lit(d) for d in (-1, 0, 1)))).when(F.col("x") == 0, F.array(F.lit(-1), F.lit(0))).when(F.col("x") == width - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    copies = copies.withColumn("_cy", F.explode(F.when(F.lit(height) == 1, F.array(*(F.lit(d) for d in (-1, 0, 1)))).when(F.col("y") == 0, F.array(F.lit(-1), F.lit(0))).when(F.col("y") == height - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = copies.withColumn("_m", F.explode(sent)).select(*by, (F.col("x") + F.col("_cx") + F.col("_m.dx")).alias("x"), (F.col("y") + F.col("_cy") + F.col("_m.dy")).alias("y"), F.col("_m.dx").alias("_dx"), F.col("_m.dy").alias("_dy"), "v")
    out = out.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    gx = F.sum(F.when(F.col("_dx") != 0, weight(F.col("_dx"), 0) * (2 - F.abs("_dy")) / 2 * F.col("v")).otherwise(0.0))
    gy = F.sum(F.when(F.col("_dy") != 0, weight(F.col("_dy"), 0) * (2 - F.abs("_dx")) / 2 * F.col("v")).otherwise(0.0))
    return out.groupBy(*by, "x", "y").agg(F.sqrt(gx * gx + gy * gy).alias("gradient"))


def tf_domain(voxels: DataFrame, by: list[str], step: int = 1, v: str = "v", index: str = "i") -> DataFrame:
    """lo and hi for a transfer function from every step-th finite value: where a floor band (1/256 of the range) holds over
    a fifth, it is left out; hi is the value at 0.99 of the rest."""
    sample = voxels.filter((F.col(index) % step == 0) & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ends = sample.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("top"), F.count("*").alias("_n"))
    floor_ = F.col(v) <= F.col("lo") + (F.col("top") - F.col("lo")) / 256
    sized = sample.join(ends, by)
    low = sized.groupBy(*by).agg(F.avg(floor_.cast("double")).alias("_share"))
    rest = sized.join(low, by).filter(~(floor_ & (F.col("_share") > 0.2)))
    return rest.groupBy(*by, "lo").agg(F.percentile_approx(v, 0.99, 100_000).alias("hi"))


def sample_trilinear(points: DataFrame, grid: DataFrame, by: tuple[str, ...] = ("series",), key: str = "point_id") -> DataFrame:
    """by, key, v: the grid's value at each point (px, py, pz in voxels) from its eight corners; null where one is missing.

    A point sends its weight to each corner with one, so the lookup is an equi-join on the voxel."""
    corners = F.array(*(F.struct(*(F.lit(d >> k & 1).alias(f"d{c}") for k, c in enumerate("xyz"))) for d in range(8)))
    sent = points.withColumn("_d", F.explode(corners))
    for c in "xyz":
        low = F.floor(F.col(f"p{c}"))
        part = F.col(f"p{c}") - low
        sent = sent.withColumn(c, (low + F.col(f"_d.d{c}")).cast("int")).withColumn(f"_w{c}", F.when(F.col(f"_d.d{c}") == 1, part).otherwise(1 - part))
    sent = sent.withColumn("_w", F.col("_wx") * F.col("_wy") * F.col("_wz")).filter("_w > 0").select(*by, key, "x", "y", "z", "_w")
    met = sent.join(grid.select(*by, "x", "y", "z", "v"), [*by, "x", "y", "z"], "left")
    return met.groupBy(*by, key).agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("_w") * F.col("v"))).alias("v"))


def oblique_projection(rays: DataFrame, grid: DataFrame, steps: int, mode: str = "max", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, ray_id, v: max, min or mean of the samples along each ray (ox, oy, oz and a step dx, dy, dz); 0 without a hit."""
    along = rays.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    points = along.select(*by, F.struct("ray_id", "_t").alias("at"), *((F.col(f"o{c}") + F.col("_t") * F.col(f"d{c}")).alias(f"p{c}") for c in "xyz"))
    how = {"max": F.max, "min": F.min, "mean": F.avg}[mode]
    return sample_trilinear(points, grid, by, "at").groupBy(*by, F.col("at.ray_id").alias("ray_id")).agg(F.coalesce(how("v"), F.lit(0.0)).alias("v"))


def rasterize(contours: DataFrame, width: int, by: tuple[str, ...] = ("roi", "z")) -> DataFrame:
    """by, x, y: pixels whose centre lies inside closed contours (contour, order, px, py), even-odd over all of one plane.

    An edge meets the rows between its ends; the crossings of a row, sorted, pair up to spans, which share no pixel.  A small
    file of contours makes many crossings: these are dealt over all tasks and sorted there, and no pixels are held."""
    from pyspark.sql import Window

    from .graph import dealt

    ring = Window.partitionBy(*by, "contour")
    next_ = lambda c: F.coalesce(F.lead(c).over(ring.orderBy("order")), F.first(c).over(ring.orderBy("order")))
    edges = dealt(contours, *by, "contour").withColumn("qx", next_("px")).withColumn("qy", next_("py")).filter("py <> qy")
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    # A row's centre y crosses an edge where low <= y < high, so a vertex counts once.
    rows = edges.withColumn("y", F.explode(F.when(F.ceil(low) <= F.ceil(high) - 1, F.sequence(F.ceil(low), F.ceil(high) - 1)))).withColumn("at", F.col("px") + (F.col("y") - F.col("py")) / (F.col("qy") - F.col("py")) * (F.col("qx") - F.col("px")))
    row = Window.partitionBy(*by, "y").orderBy("at", "contour", "order")
    spans = dealt(rows.select(*by, "contour", "order", "y", "at"), *by, "y").withColumn("k", F.row_number().over(row)).withColumn("end", F.lead("at").over(row)).filter("k % 2 = 1 and end is not null")
    first, last = F.greatest(F.ceil("at"), F.lit(0)), F.least(F.ceil("end") - 1, F.lit(width - 1))
    return spans.withColumn("x", F.explode(F.when(first <= last, F.sequence(first, last)))).select(*by, "x", "y")


def run_lengths(pixels: DataFrame, by: list[str], order: str, v: str = "v") -> DataFrame:
    """by, start, length and value of runs of equal values in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce((F.col(v) != F.lag(v).over(w)).cast("int"), F.lit(1))
    marked = pixels.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return marked.groupBy(*by, "_g").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.first(v).alias("value")).drop("_g")


def level_set(pixels: DataFrame, band: int = 2, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """One pass of a two-mean level set over pixels (x, y, v, mask 0 or 1): pixels with one of the other side within the
    band join the side whose mean is nearer, the inside on ties.  Where a side is empty or both means agree, all stays.

    All pixels are judged by the mask as it was, so the result does not depend on an order."""
    means = pixels.groupBy(*by).agg(F.avg(F.when(F.col("mask") == 1, F.col("v"))).alias("_in"), F.avg(F.when(F.col("mask") == 0, F.col("v"))).alias("_out"))
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-band, band + 1) for dy in range(-band, band + 1)))
    sent = pixels.withColumn("_m", F.explode(moves)).select(*by, (F.col("x") + F.col("_m.dx")).alias("x"), (F.col("y") + F.col("_m.dy")).alias("y"), "mask")
    sides = sent.groupBy(*by, "x", "y").agg(F.min("mask").alias("_lo"), F.max("mask").alias("_hi"))
    near = F.abs(F.col("v") - F.col("_in")) <= F.abs(F.col("v") - F.col("_out"))
    moved = (F.col("_lo") != F.col("_hi")) & F.coalesce(F.col("_in") != F.col("_out"), F.lit(False))
    joined = pixels.join(sides, [*by, "x", "y"]).join(means, list(by))
    return joined.withColumn("mask", F.when(moved, near.cast("int")).otherwise(F.col("mask"))).drop("_in", "_out", "_lo", "_hi")


def profile_lines(lines: DataFrame, voxels: DataFrame, samples: int = 64, by: str = "series") -> DataFrame:
    """line_id, k, v: the values under `samples` points from (ax, ay, az) to (bx, by_, bz), each rounded half up to its voxel.

    A point without a voxel has a null value.  lines carry the series of their volume; points meet voxels by equal keys."""
    t = F.col("k") / F.lit(max(samples - 1, 1))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * t + 0.5).cast("int")
    points = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("line_id", "k", by, at("ax", "bx").alias("x"), at("ay", "by_").alias("y"), at("az", "bz").alias("z"))
    return points.join(voxels.select(by, "x", "y", "z", "v"), [by, "x", "y", "z"], "left").select("line_id", "k", "v")


def cumulative_dose(doses: DataFrame, by: str, value: str = "v", bins: int = 100) -> DataFrame:
    """by, bin, share: of each structure's voxels, the share with a dose of at least bin / bins of its largest.

    Counts per bin come first, so the running sum is over bins of a structure, not over its voxels."""
    top = doses.groupBy(by).agg(F.max(value).alias("top"), F.count(value).alias("n")).filter("top > 0")
    placed = doses.join(top, by).select(by, "n", F.floor(F.col(value) / F.col("top") * bins).cast("int").alias("bin"))
    counts = placed.groupBy(by, "n", "bin").agg(F.count("*").alias("c"))
    every = counts.groupBy(by, "n").agg(F.collect_list(F.struct("bin", "c")).alias("h")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins))))
    least = F.aggregate("h", F.lit(0).cast("bigint"), lambda s, e: s + F.when(e["bin"] >= F.col("bin"), e["c"]).otherwise(0))
    return every.select(by, "bin", (least / F.col("n")).alias("share"))


def through_spheres(points: DataFrame, wanted: list[tuple[float, float, float, float]], barred: list[tuple[float, float, float, float]], line: str = "line_id") -> DataFrame:
    """Lines (of points x, y, z) with a point in every wanted sphere (x, y, z, radius) and none in a barred one.

    One pass with partial aggregation: whether any point of the line lies in each sphere."""
    inside = lambda s: F.pow(F.col("x") - s[0], 2) + F.pow(F.col("y") - s[1], 2) + F.pow(F.col("z") - s[2], 2) <= s[3] * s[3]
    hits = [F.max(F.coalesce(inside(s), F.lit(False))).alias(f"h{k}") for k, s in enumerate([*wanted, *barred])]
    keep = F.lit(True)
    for k in range(len(wanted) + len(barred)):
        keep = keep & (F.col(f"h{k}") if k < len(wanted) else ~F.col(f"h{k}"))
    return points.groupBy(line).agg(F.count("*").alias("n_points"), *hits).filter(keep).select(line, "n_points")


def fuse_slices(
    base: DataFrame, overlay: DataFrame, dims: tuple[int, int, int], overlay_dims: tuple[int, int, int], plane: str, index: int, base_window: tuple[float, float], overlay_window: tuple[float, float],
    mode: str = "checker", alpha: float = 0.5, checker: int = 16, by: tuple[str, ...] = ("series",),
) -> DataFrame:
    """(by, u, v, grey): one slice of base with the overlay's nearest voxels, after their windows (width, center).

    The overlay is read at the base's places, rescaled by the two sizes: an equi-join.  checker: tiles in turn; alpha: a blend;
    subtract: overlay less base, the middle grey where they agree.  A voxel that a volume lacks leaves its pixel out."""
    if not 0 <= alpha <= 1:
        raise ValueError(f"fusion-bad-alpha: {alpha}")
    if checker != int(checker) or checker < 2:
        raise ValueError(f"fusion-bad-checker: {checker}")
    axis, (u, v) = PLANES[plane]
    at = min(max(index, 0), dims["xyz".index(axis)] - 1)
    near = lambda c, k: F.least(F.lit(overlay_dims[k] - 1), F.floor(F.col(c) * overlay_dims[k] / dims[k] + 0.5))
    slice_ = base.filter(F.col(axis) == at).select(*by, *"xyz", F.col("v").alias("_b")).withColumns({f"_{c}": near(c, k) for k, c in enumerate("xyz")})
    other = overlay.select(*by, *(F.col(c).cast("bigint").alias(f"_{c}") for c in "xyz"), F.col("v").alias("_o"))
    rows = slice_.join(other, [*by, "_x", "_y", "_z"])
    below, above = (F.floor(scalars.window_level(F.col(c), *w) + 0.5) for c, w in (("_b", base_window), ("_o", overlay_window)))
    if mode == "checker":
        grey = F.when((F.floor(F.col(u) / checker) + F.floor(F.col(v) / checker)) % 2 == 1, above).otherwise(below)
    elif mode == "alpha":
        grey = below * (1 - alpha) + above * alpha
    elif mode == "subtract":
        half = max(1.0, base_window[0] / 2)
        grey = 127.5 + (F.col("_o") - F.col("_b")) / half * 127.5
    else:
        raise ValueError(f"fusion-bad-mode: {mode}")
    return rows.select(*by, F.col(u).alias("u"), F.col(v).alias("v"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor(grey + 0.5))).cast("int").alias("grey"))

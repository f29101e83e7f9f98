"""Graphs: closures over trees, connected components, growth, neighbours of pixels."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rounds whose results become one table, so that long iterations do not grow the plan.
FOLD = 32


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='morpholake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: iterations neither grow the plan nor rest on one executor."""
    path = f"{_shared(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as a shuffle has (rows of equal keys in one, if given), before its rows become many or are compared
    with many: a small file is one task as it is read, and a small shuffle is coalesced to one."""
    return df.repartition(tasks_of(df), *by)


def tasks_of(df: DataFrame) -> int:
    """As many tasks as a shuffle of df has, and at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over parent edges (node, parent), itself at 0; a cycle ends where it would repeat a node.

    Each round joins the frontier with the edges, however deep the tree; it ends when no node has a further parent."""
    nodes = edges.select("node").union(edges.select(F.col("parent").alias("node"))).filter("node is not null").distinct()
    frontier = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"), F.array("node").alias("_path"))
    out = frontier
    up = edges.filter("parent is not null").select(F.col("node").alias("_n"), "parent").distinct()
    for k in count(1):
        frontier = frontier.join(up, frontier["ancestor"] == up["_n"]).filter(~F.array_contains("_path", F.col("parent")))
        frontier = cut(frontier.select("node", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("_path", F.array("parent")).alias("_path")))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
        if k % FOLD == 0:
            out = cut(out)
    return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def children(edges: DataFrame, of: Column) -> DataFrame:
    return edges.filter(F.col("parent") == of).select("node")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b); a lone node is its own.

    Hooks every root under the smallest root it has an edge to, two hops a round, until no edge joins two roots."""
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    roots = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while not left.isEmpty():
        hook = cut(left.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("to")))
        hook = cut(hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.k"), "left").select(F.col("x.k").alias("k"), F.coalesce("y.to", "x.to").alias("to")))
        roots = cut(roots.join(hook, roots["component"] == hook["k"], "left").select("node", F.coalesce("to", "component").alias("component")))
        first, second = hook.select(F.col("k").alias("k1"), F.col("to").alias("t1")), hook.select(F.col("k").alias("k2"), F.col("to").alias("t2"))
        moved = left.join(first, left["a"] == first["k1"], "left").select(F.coalesce("t1", "a").alias("a"), "b")
        moved = moved.join(second, moved["b"] == second["k2"], "left").select("a", F.coalesce("t2", "b").alias("b"))
        left = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return roots


def grid_edges(cells: DataFrame, node: str, axes: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Edges between cells that differ by one on one axis: one equi-join per axis."""
    out = None
    for a in axes:
        same = [*by, *(c for c in axes if c != a)]
        one = cells.select(*same, a, F.col(node).alias("a"))
        next_ = cells.select(*same, (F.col(a) - 1).alias(a), F.col(node).alias("b"))
        pairs = one.join(next_, [*same, a]).select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def label_cells(pixels: DataFrame, width: int, threshold: float, least: int = 1) -> DataFrame:
    """Cells of a tile (tile, x, y, v): groups of face neighbours over the threshold, with their shape.

    tile, first (the smallest pixel index), area, cx, cy (weighted by v), mean, bounding box, perimeter (open edges), extent,
    form factor (1 at most), aspect.  Cells under `least` pixels are dropped."""
    import math

    on = pixels.filter(F.col("v") > threshold).withColumn("node", F.struct("tile", (F.col("y") * width + F.col("x")).alias("i")))
    edges = cut(grid_edges(on, "node", ("x", "y"), ("tile",)))
    comp = components(on, edges)
    labelled = on.join(comp, "node")
    inner = edges.join(comp, edges["a"] == comp["node"]).groupBy("component").agg(F.count("*").alias("inner"))
    stats = labelled.groupBy("component").agg(
        F.count("*").alias("area"), (F.sum(F.col("x") * F.col("v")) / F.sum("v")).alias("cx"), (F.sum(F.col("y") * F.col("v")) / F.sum("v")).alias("cy"), F.avg("v").alias("mean"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    joined = stats.join(inner, "component", "left").filter(F.col("area") >= least)
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    perimeter = 4 * F.col("area") - 2 * F.coalesce("inner", F.lit(0))
    form = F.least(F.lit(1.0), 4 * math.pi * F.col("area") / (perimeter * perimeter))
    return joined.select(F.col("component.tile").alias("tile"), F.col("component.i").alias("first"), "area", "cx", "cy", "mean", "x0", "y0", "x1", "y1", perimeter.alias("perimeter"), (F.col("area") / (w * h)).alias("extent"), form.alias("form_factor"), (F.greatest(w, h) / F.least(w, h)).alias("aspect"))


def region_grow(cells: DataFrame, node: str, edges: DataFrame, seeds: DataFrame, within: Column) -> DataFrame:
    """Cells in the window that seeds reach over edges: the seeds' components among the cells in the window."""
    kept = cells.filter(within).select(F.col(node).alias("node"))
    inside = edges.join(kept.select(F.col("node").alias("a")), "a", "left_semi").join(kept.select(F.col("node").alias("b")), "b", "left_semi")
    comp = components(kept, inside)
    wanted = comp.join(seeds.select("node"), "node", "left_semi").select("component").distinct()
    return comp.join(wanted, "component", "left_semi").select("node")


def pockets(points: DataFrame, contacts: DataFrame, buried: int, least: int) -> DataFrame:
    """Groups of exposed points (under `buried` contacts) in contact with one another, of at least so many points."""
    ends = contacts.select(F.col("a").alias("node")).union(contacts.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    exposed = cut(points.select("node").join(ends, "node", "left").fillna(0, ["degree"]).filter(F.col("degree") < buried))
    ids = exposed.select("node")
    inner = contacts.select("a", "b").join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(ids.withColumnRenamed("node", "b"), "b", "left_semi")
    comp = components(exposed, inner).join(exposed, "node")
    return comp.groupBy("component").agg(F.count("*").alias("n"), F.avg("degree").alias("mean_degree")).filter(F.col("n") >= least)


def fill_holes(mask: DataFrame, width: int, height: int, by: tuple[str, ...] = ("series", "z"), label: int | None = None, locked: tuple[int, ...] = ()) -> DataFrame:
    """Pixels of a slice that the mask (rows of set pixels) encloses: background components that reach no border.

    With a label they leave with it; with label 0, and mask rows that have one, with the label that borders the slice's holes
    most often (the least on ties).  Where that label is locked, the slice's holes stay open."""
    slices = mask.select(*by).distinct()
    grid = slices.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    empty = cut(grid.join(mask, [*by, "x", "y"], "left_anti").withColumn("node", F.struct(*by, "y", "x")))
    comp = components(empty, cut(grid_edges(empty, "node", ("x", "y"), by)))
    edge = (F.col("node.x") == 0) | (F.col("node.y") == 0) | (F.col("node.x") == width - 1) | (F.col("node.y") == height - 1)
    open_ = comp.filter(edge).select("component").distinct()
    holes = comp.join(open_, "component", "left_anti").select("node.*")
    if label is None:
        return holes
    if label:
        return holes.withColumn("label", F.lit(label)).filter(~F.col("label").isin(*locked))
    holes = cut(holes)
    beside = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    votes = holes.select(*by, F.explode(beside).alias("_n")).select(*by, "_n.*").join(mask.select(*by, "x", "y", "label"), [*by, "x", "y"]).groupBy(*by, "label").agg(F.count("*").alias("n"))
    best = votes.groupBy(*by).agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))
    return holes.join(best.filter(~F.col("label").isin(*locked)), list(by))


def _inner(mask: DataFrame, axes: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """Cells of the mask with a neighbour on either side of each axis: each cell votes for its neighbours, one shuffle."""
    steps = F.array(*(F.struct(*((F.col(c) + (d if c == a else 0)).alias(c) for c in axes), F.lit(1).alias("vote")) for a in axes for d in (1, -1)), F.struct(*axes, F.lit(0).alias("vote")))
    votes = mask.select(*by, F.explode(steps).alias("_s")).select(*by, "_s.*")
    counted = votes.groupBy(*by, *axes).agg(F.sum("vote").alias("votes"), F.min("vote").alias("own"))
    return counted.filter((F.col("own") == 0) & (F.col("votes") == 2 * len(axes))).select(*by, *axes)


def border_distance(mask: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Steps from each voxel of the mask to the nearest voxel outside, over faces: one erosion per step, until nothing is left."""
    left, k = mask.select(*by, *axes), 0
    out = left.limit(0).withColumn("distance", F.lit(0))
    while not left.isEmpty():
        inner = cut(_inner(left, axes, by))
        k += 1
        ring = left.join(inner, [*by, *axes], "left_anti").withColumn("distance", F.lit(k))
        out = out.unionByName(ring)
        if k % FOLD == 0:
            out = cut(out)
        left = inner
    return out


def sizes(comp: DataFrame) -> DataFrame:
    """component, n: how many nodes each component has."""
    return comp.groupBy("component").agg(F.count("*").alias("n"))


def largest_component(comp: DataFrame) -> DataFrame:
    """The nodes of the largest component, the one of the smallest label on ties."""
    best = sizes(comp).orderBy(F.desc("n"), "component").limit(1).select("component")
    return comp.join(best, "component", "left_semi")


def without_small(comp: DataFrame, least: int) -> DataFrame:
    small = sizes(comp).filter(F.col("n") < least).select("component")
    return comp.join(small, "component", "left_anti")

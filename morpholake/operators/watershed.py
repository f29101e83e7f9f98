"""Watershed splitting of masks by their shape, as rounds of joins over all volumes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import border_distance, components, cut, grid_edges


def split(mask: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, axes and basin of each voxel of the mask; basin is the place of its founder, null on the lines where basins meet.

    Levels of border_distance are flooded from the inside out.  On a level, basins spread by a ring a round: a voxel that
    touches one basin joins it, one that touches several is a line, and of neighbours that two basins claim in the same
    round the later one is a line.  Each patch that no basin reaches founds a basin of its own.  So no two basins touch,
    and a mask of single blobs has no lines.  Voxels without a row count as background, those beyond the grid too.
    Repeated rows count once, rows with a null in by or axes never meet a neighbour, an empty mask gives no rows.

    Rounds depend on the width of the shapes, not on how many volumes there are.  Each ring is written to the shared
    folder; a level's rings become one table at its end."""
    voxels = mask.select(*by, *axes).distinct()
    cells = cut(border_distance(voxels, axes, by).select(F.struct(*by, *axes).alias("node"), *by, *axes, "distance"))
    one_way = grid_edges(cells, "node", axes, by)
    edges = cut(one_way.union(one_way.select("b", "a")))
    done = cells.select("node", F.col("node").alias("basin")).limit(0)
    top = cells.agg(F.max("distance")).first()[0] or 0
    for level in range(top, 0, -1):
        done = cut(done)
        open_ = cells.filter(F.col("distance") == level).select("node")
        while True:
            settled = done.filter("basin is not null").select(F.col("node").alias("b"), "basin")
            meets = edges.join(open_.withColumnRenamed("node", "a"), "a", "left_semi").join(settled, "b")
            claims = meets.groupBy("a").agg(F.min("basin").alias("low"), F.max("basin").alias("high"))
            ring = cut(claims.select(F.col("a").alias("node"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("basin")))
            if ring.isEmpty():
                break
            later, sooner = ring.select(F.col("node").alias("a"), F.col("basin").alias("own")), ring.select(F.col("node").alias("b"), F.col("basin").alias("other"))
            pairs = edges.filter("b < a").join(later, "a").join(sooner, "b")
            clash = pairs.filter("own <> other").select(F.col("a").alias("_late")).distinct()
            ring = ring.join(clash, ring["node"] == clash["_late"], "left").select("node", F.when(F.col("_late").isNull(), F.col("basin")).alias("basin"))
            done = done.unionByName(ring := cut(ring))
            open_ = cut(open_.join(ring.select("node"), "node", "left_anti"))
        inner = edges.join(open_.withColumnRenamed("node", "a"), "a", "left_semi").join(open_.withColumnRenamed("node", "b"), "b", "left_semi")
        done = done.unionByName(components(open_, inner).select("node", F.col("component").alias("basin")))
    done = cut(done)
    return done.select("node.*", F.when(F.col("basin").isNotNull(), F.struct(*(F.col(f"basin.{a}").alias(a) for a in axes))).alias("basin"))

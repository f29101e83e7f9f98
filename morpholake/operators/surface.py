"""Surfaces of voxel tables (series, x, y, z, v) as triangle tables: dual surface extraction, relaxation, normals, volumes.

A volume is cut into bricks of cells; a brick's group holds its voxels and a halo of one, whatever the size of the volume, so
that one large volume is many tasks.  A vertex is named by its cell (packed into one long), so bricks agree on names without
numbering anything.  Missing voxels leave their cells without a surface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import cut

BRICK = 16
#: Cells of a halo are enough for as many relaxation steps at once.
HALO = 8
PROJECTIONS = 3
#: A cell's name: 21 bits for each coordinate, from -2^20 on.
SHIFT, BIAS = 21, 1 << 20
CORNERS = np.array([[c & 1, c >> 1 & 1, c >> 2] for c in range(8)])
#: Corners that an edge of a cell joins.
EDGES = [(a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1]

Arrays = dict[str, np.ndarray]


def cell_name(x: Any, y: Any, z: Any) -> Any:
    return ((z + BIAS) << 2 * SHIFT) + ((y + BIAS) << SHIFT) + (x + BIAS)


def cell_of(name: np.ndarray) -> np.ndarray:
    low = (1 << SHIFT) - 1
    return np.stack([(name & low) - BIAS, (name >> SHIFT & low) - BIAS, (name >> 2 * SHIFT) - BIAS], axis=-1)


def by_bricks(rows: DataFrame, run: Callable[[tuple[int, int, int], Arrays], Arrays], out: str, by: tuple[str, ...], size: int = BRICK, halo: int = 1) -> DataFrame:
    """run(brick, its rows' columns as arrays) of every brick of size cells a side, with rows up to halo around it (x, y, z)."""
    near = lambda c: F.array_distinct(F.transform(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)), lambda b: b.cast("long")))
    for c in "xyz":
        rows = rows.withColumn(f"brick_{c}", F.explode(near(c)))
    keys = [*by, "brick_x", "brick_y", "brick_z"]
    kinds = T.StructType([*(rows.schema[b] for b in by), *T.StructType.fromDDL(out)])

    nothing = to_arrow_schema(kinds).empty_table()

    def brick(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in keys}
        at = tuple(table.column(f"brick_{c}")[0].as_py() for c in "xyz")
        if not np.logical_and.reduce([columns[c] // size == b for c, b in zip("xyz", at, strict=True)]).any():
            return nothing  # a brick of halo rows only makes nothing
        made = run(at, columns)
        n = len(next(iter(made.values())))
        group = [pa.array([table.column(b)[0].as_py()] * n, table.column(b).type) for b in by]
        return pa.table([*group, *(pa.array(a) for a in made.values())], names=[*by, *made])

    return rows.groupBy(*keys).applyInArrow(brick, kinds)


def _trilinear(g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, gradient) of cells with corner values g (n, 8) at places p (n, 3) within them."""
    side = np.stack([1 - p, p], axis=-1)  # (n, axis, corner's bit)
    parts = [side[:, k, CORNERS[:, k]] for k in range(3)]
    value = (g * parts[0] * parts[1] * parts[2]).sum(1)
    slope = np.where(CORNERS, 1.0, -1.0)
    others = (parts[1] * parts[2], parts[0] * parts[2], parts[0] * parts[1])
    return value, np.stack([(g * slope[:, k] * others[k]).sum(1) for k in range(3)], axis=-1)


def vertices_of(g: np.ndarray) -> np.ndarray:
    """Places (0 to 1 along each axis) of the vertices of cells with corner values g less the level: the mean of the
    crossings of their edges, moved along the gradient onto the trilinear surface."""
    total, n = np.zeros((len(g), 3)), np.zeros(len(g))
    for a, b in EDGES:
        ga, gb = g[:, a], g[:, b]
        cross = (ga > 0) != (gb > 0)
        t = np.where(cross, ga, 0) / np.where(cross, ga - gb, 1)
        total += np.where(cross[:, None], CORNERS[a] + t[:, None] * (CORNERS[b] - CORNERS[a]), 0)
        n += cross
    p = total / np.maximum(n, 1)[:, None]
    for _ in range(PROJECTIONS):
        value, slope = _trilinear(g, p)
        square = (slope**2).sum(1)
        step = np.where(square < 1e-24, 0, value / np.where(square < 1e-24, 1, square))
        p = np.clip(p - step[:, None] * slope, 0, 1)
    return p


def _dense(brick: tuple[int, int, int], rows: Arrays, size: int) -> np.ndarray:
    """Values of a brick and its halo of one as a cube [x, y, z], NaN where none is."""
    cube = np.full((size + 2,) * 3, np.nan)
    cube[tuple(rows[c] - b * size + 1 for c, b in zip("xyz", brick, strict=True))] = rows["v"]
    return cube


def _sample(cube: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Trilinear values at places p in samples of the cube."""
    low = np.clip(np.floor(p).astype(int), 0, len(cube) - 2)
    at = low[:, None, :] + CORNERS[None]
    return _trilinear(np.nan_to_num(cube[at[..., 0], at[..., 1], at[..., 2]]), p - low)[0]


def _quads(brick: tuple[int, int, int], cube: np.ndarray, iso: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four cells of each quad in the brick's own coordinates, its axis, +1 or -1 where the outside lies): one for every grid
    edge from a low corner of the brick's cells that changes sign and has four whole cells around it."""
    n = size + 1
    corner = [cube[x : x + n, y : y + n, z : z + n] for x, y, z in CORNERS]
    whole = ~np.isnan(sum(corner))
    inside = cube > iso
    cells, axes, signs = [], [], []
    for k in range(3):
        step = np.eye(3, dtype=int)
        u, v = step[(k + 1) % 3], step[(k + 2) % 3]
        own = np.stack(np.meshgrid(*[np.arange(1, n)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
        low, high = inside[tuple(own.T)], inside[tuple((own + step[k]).T)]
        own, low = own[low != high], low[low != high]
        around = np.stack([own - u - v, own - v, own, own - u], axis=1)
        full = whole[around[..., 0], around[..., 1], around[..., 2]].all(1)
        cells.append(around[full])
        axes.append(np.full(full.sum(), k))
        signs.append(np.where(low[full], 1, -1))
    return np.concatenate(cells), np.concatenate(axes), np.concatenate(signs)


def _wound(p: np.ndarray, axis: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of each quad's corners so that it looks outwards, its normal of twice its first triangle's area)."""
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    flip = np.take_along_axis(normal, axis[:, None], 1)[:, 0] * sign < 0
    return np.where(flip[:, None], [0, 3, 2, 1], [0, 1, 2, 3]), np.where(flip[:, None], -normal, normal)


def _split(order: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(n, 2, 3): corners of the two triangles of each quad, along the other diagonal where it is chosen."""
    turned = np.where(other[:, None], np.roll(order, -1, axis=1), order)
    return turned[:, [[0, 1, 2], [0, 2, 3]]]


TRIANGLE = "a long, b long, c long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz") + ", half int, nx double, ny double, nz double"


def _triangles(names: np.ndarray, p: np.ndarray, corners: np.ndarray, normal: np.ndarray) -> Arrays:
    out = {}
    rows = np.arange(len(names))[:, None]
    for j, k in enumerate("abc"):
        out[k] = names[rows, corners[:, :, j]].ravel()
    for j, k in enumerate("abc"):
        for i, c in enumerate("xyz"):
            out[f"{k}{c}"] = p[rows, corners[:, :, j], i].ravel()
    out["half"] = np.tile(np.array([0, 1], np.int32), len(names))
    for i, c in enumerate("xyz"):
        out[f"n{c}"] = np.repeat(normal[:, i], 2)
    return out


def nets(voxels: DataFrame, iso: float, by: tuple[str, ...] = ("series",), size: int = BRICK) -> DataFrame:
    """Triangles of the surface where v crosses iso (inside above it), in voxel coordinates: voxel i's centre is i + 0.5.

    A row has its vertices' names and places, and the normal of its quad (half: which triangle of the quad it is)."""

    def run(brick: tuple[int, int, int], rows: Arrays) -> Arrays:
        cube = _dense(brick, rows, size)
        cells, axis, sign = _quads(brick, cube, iso, size)
        flat, back = np.unique(cells.reshape(-1, 3), axis=0, return_inverse=True)
        at = flat[:, None, :] + CORNERS[None]
        local = flat + vertices_of(cube[at[..., 0], at[..., 1], at[..., 2]] - iso) if len(flat) else np.zeros((0, 3))
        low = np.array(brick) * size - 1
        p = local[back.reshape(-1, 4)]
        order, normal = _wound(p, axis, sign)
        wound = np.take_along_axis(p, order[..., None], 1)
        off = [abs(_sample(cube, (wound[:, i] + wound[:, i + 2]) / 2) - iso) for i in (0, 1)] if len(p) else [np.zeros(0)] * 2
        return _triangles(cell_name(*np.moveaxis(cells + low, -1, 0)), p + low + 0.5, _split(order, off[1] < off[0]), normal)

    return by_bricks(voxels.select(*by, "x", "y", "z", F.col("v").cast("double").alias("v")), run, TRIANGLE, by, size)


def mesh_vertices(triangles: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(id, x, y, z, nx, ny, nz): every vertex with the unit mean of its quads' normals, weighted by their areas."""
    corner = lambda k: F.struct(F.col(k).alias("id"), *(F.col(f"{k}{c}").alias(c) for c in "xyz"))
    new = F.when(F.col("half") == 0, F.array(corner("a"), corner("b"), corner("c"))).otherwise(F.array(corner("c")))
    rows = triangles.select(*by, F.explode(new).alias("v"), "nx", "ny", "nz").groupBy(*by, "v.id").agg(*(F.first(f"v.{c}").alias(c) for c in "xyz"), *(F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"))
    length = F.sqrt(sum((F.col(f"n{c}") ** 2 for c in "xyz"), F.lit(0.0)))
    return rows.select(*by, "id", "x", "y", "z", *((F.col(f"n{c}") / F.when(length > 0, length).otherwise(1.0)).alias(f"n{c}") for c in "xyz"))


def _cross(p: str, q: str) -> list[Column]:
    c = lambda k, i: F.col(f"{k}{i}") - F.col(f"a{i}")
    return [c(p, i) * c(q, j) - c(p, j) * c(q, i) for i, j in ("yz", "zx", "xy")]


def signed_volume() -> Column:
    """Of a triangle with the origin; the sum over a closed surface is what it encloses."""
    d = lambda i, j: F.col(f"b{i}") * F.col(f"c{j}") - F.col(f"b{j}") * F.col(f"c{i}")
    return (F.col("ax") * d("y", "z") + F.col("ay") * d("z", "x") + F.col("az") * d("x", "y")) / 6


def area() -> Column:
    return F.sqrt(sum((c * c for c in _cross("b", "c")), F.lit(0.0))) / 2


def measures(triangles: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Triangles, area and enclosed volume of each surface."""
    return triangles.groupBy(*by).agg(F.count(F.lit(1)).alias("n_triangles"), F.sum(area()).alias("area"), F.sum(signed_volume()).alias("volume"))


QUAD = ", ".join(f"q{k} long" for k in range(4)) + ", axis int, sign int"


def mask_quads(mask: DataFrame, by: tuple[str, ...] = ("series",), size: int = BRICK) -> DataFrame:
    """Quads of the surface of a mask (v 0 or 1 for every voxel of the grid): four cells, the axis and where the outside lies."""

    def run(brick: tuple[int, int, int], rows: Arrays) -> Arrays:
        cells, axis, sign = _quads(brick, _dense(brick, rows, size), 0.5, size)
        names = cell_name(*np.moveaxis(cells + np.array(brick) * size - 1, -1, 0))
        return {**{f"q{k}": names[:, k] for k in range(4)}, "axis": axis.astype(np.int32), "sign": sign.astype(np.int32)}

    return by_bricks(mask.select(*by, "x", "y", "z", F.col("v").cast("double").alias("v")), run, QUAD, by, size)


def _mask_vertices(mask: DataFrame, by: tuple[str, ...], size: int) -> DataFrame:
    """(id, px, py, pz) of the cells that the surface of a mask passes."""

    def run(brick: tuple[int, int, int], rows: Arrays) -> Arrays:
        cube = _dense(brick, rows, size)[1:, 1:, 1:]
        g = np.stack([cube[x : x + size, y : y + size, z : z + size] for x, y, z in CORNERS], axis=-1).reshape(-1, 8) - 0.5
        some = np.flatnonzero(~np.isnan(g).any(1) & ((g > 0).any(1) != (g > 0).all(1)))
        cells = np.stack(np.unravel_index(some, (size,) * 3), axis=-1) + np.array(brick) * size
        p = cells + vertices_of(g[some]) + 0.5
        return {"id": cell_name(*cells.T), "px": p[:, 0], "py": p[:, 1], "pz": p[:, 2]}

    return by_bricks(mask.select(*by, "x", "y", "z", F.col("v").cast("double").alias("v")), run, "id long, px double, py double, pz double", by, size)


def relax(vertices: DataFrame, quads: DataFrame, steps: list[float], by: tuple[str, ...] = ("series",), size: int = BRICK, halo: int = HALO) -> DataFrame:
    """Vertices (id, px, py, pz) moved towards the mean of their neighbours along quad edges, never out of their cells.

    A step moves all at once, by the step's share of the way.  A brick with a halo of h cells does h steps by itself, as a
    step reaches one cell far; so rounds over all data are fewer by that factor."""
    ring = [(k, (k + 1) % 4) for k in range(4)]
    pairs = F.array(*(F.struct(F.col(f"q{a}").alias("id"), F.col(f"q{b}").alias("next")) for i, j in ring for a, b in ((i, j), (j, i))))
    edges = cut(quads.select(*by, F.explode(pairs).alias("e")).select(*by, "e.*").groupBy(*by, "id").agg(F.collect_list("next").alias("nexts")))
    low = F.lit((1 << SHIFT) - 1)
    place = [((F.shiftright("id", SHIFT * k).bitwiseAND(low)) - BIAS).alias(c) for k, c in enumerate("xyz")]
    at = vertices
    for begin in range(0, len(steps), halo):
        some = steps[begin : begin + halo]

        def run(brick: tuple[int, int, int], rows: Arrays, some: list[float] = some) -> Arrays:
            order = np.argsort(rows["id"])
            names, p = rows["id"][order], np.stack([rows[f"p{c}"] for c in "xyz"], axis=-1)[order]
            nexts = [x if x is not None else [] for x in rows["nexts"][order]]
            degree = np.array([len(x) for x in nexts])
            source = np.repeat(np.arange(len(names)), degree)
            target = np.concatenate([np.asarray(x, np.int64) for x in nexts]) if len(source) else np.zeros(0, np.int64)
            found = np.minimum(np.searchsorted(names, target), len(names) - 1)
            known = names[found] == target  # beyond the halo: of no effect on the brick within these steps
            source, found = source[known], found[known]
            count = np.maximum(np.bincount(source, minlength=len(names)), 1)[:, None]
            alone = np.bincount(source, minlength=len(names)) == 0
            floor = cell_of(names) + 0.5
            for share in some:
                mean = np.stack([np.bincount(source, p[found, i], len(names)) for i in range(3)], axis=-1) / count
                p = np.where(alone[:, None], p, np.clip(p + share * (mean - p), floor, floor + 1))
            own = (np.floor_divide(cell_of(names), size) == np.array(brick)).all(1)
            return {"id": names[own], **{f"p{c}": p[own, i] for i, c in enumerate("xyz")}}

        joined = at.join(edges, [*by, "id"], "left").select(*by, "id", *place, "px", "py", "pz", "nexts")
        at = cut(by_bricks(joined, run, "id long, px double, py double, pz double", by, size, len(some)))
    return at


def mask_nets(mask: DataFrame, by: tuple[str, ...] = ("series",), iterations: int = 20, inward: float = 0.5, outward: float = -0.53, size: int = BRICK) -> DataFrame:
    """Triangles (as of nets) of the surface of a mask (v 0 or 1 for every voxel): relaxed inside its cells, so that terraces go
    and thin parts stay; quads are split along their shorter diagonal."""
    quads, vertices = cut(mask_quads(mask, by, size)), _mask_vertices(mask, by, size)
    moved = relax(vertices, quads, [inward, outward] * iterations, by, size)
    at = quads.withColumn("_q", F.monotonically_increasing_id())
    corners = at.select(*by, "_q", "axis", "sign", F.posexplode(F.array("q0", "q1", "q2", "q3")).alias("k", "id")).join(moved, [*by, "id"])
    whole = corners.groupBy(*by, "_q").agg(F.first("axis").alias("axis"), F.first("sign").alias("sign"), F.sort_array(F.collect_list(F.struct("k", "id", "px", "py", "pz"))).alias("c"))
    names = [b for b in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("c").flatten()
            field = lambda c: flat.field(c).to_numpy(zero_copy_only=False).reshape(-1, 4)  # noqa: B023, E731
            p = np.stack([field(f"p{c}") for c in "xyz"], axis=-1)
            order, normal = _wound(p, batch.column("axis").to_numpy(), batch.column("sign").to_numpy())
            wound = np.take_along_axis(p, order[..., None], 1)
            across = [((wound[:, i] - wound[:, i + 2]) ** 2).sum(1) for i in (0, 1)]
            made = _triangles(field("id"), p, _split(order, across[1] < across[0]), normal)
            twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(b).take(twice) for b in names), *(pa.array(a) for a in made.values())], names=[*names, *made])

    return whole.mapInArrow(run, T.StructType([*(whole.schema[b] for b in by), *T.StructType.fromDDL(TRIANGLE)]))

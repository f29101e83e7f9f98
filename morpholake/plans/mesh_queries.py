"""Queries over surfaces, meshes, fills between slices, fusion and orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import orientation
from ..operators import meshes, slicefill, smoothing, surface, voxels
from .registry import query
from .tables import domain

S, D = SparkSession, DataFrame
ISO = 30
G = [f"g{k}" for k in range(8)]
BITS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]


def _corner(k: int) -> str:
    return " AND ".join([f"c{k}.series = c0.series", *(f"c{k}.{c} = c0.{c} + {b}" for c, b in zip("xyz", BITS[k], strict=True))])


def _vertex_sql() -> str:
    """Cells by their eight corners, the mean of the crossings, and three steps onto the trilinear surface."""
    cells = f"cells AS (SELECT c0.series, c0.x, c0.y, c0.z, {', '.join(f'c{k}.v - {ISO} AS g{k}' for k in range(8))} FROM solids c0 {' '.join(f'JOIN solids c{k} ON {_corner(k)}' for k in range(1, 8))})"
    some = f"crossed AS (SELECT * FROM cells WHERE greatest({', '.join(G)}) > 0 AND least({', '.join(G)}) <= 0)"
    edges = [(a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1]
    cross = lambda a, b: f"(g{a} > 0) <> (g{b} > 0)"
    n = " + ".join(f"CAST({cross(a, b)} AS INT)" for a, b in edges)

    def mean(axis: int) -> str:
        parts = [f"CASE WHEN {cross(a, b)} THEN {BITS[a][axis]} + {BITS[b][axis] - BITS[a][axis]} * g{a} / (g{a} - g{b}) ELSE 0 END" for a, b in edges]
        return f"({' + '.join(parts)}) / ({n})"

    begin = f"p0 AS (SELECT *, {', '.join(f'{mean(k)} AS {c}' for k, c in enumerate('uvw'))} FROM crossed)"
    side = lambda c, bit: c if bit else f"(1 - {c})"
    value = " + ".join(f"g{k} * {side('u', i)} * {side('v', j)} * {side('w', m)}" for k, (i, j, m) in enumerate(BITS))

    def slope(axis: int) -> str:
        others = [c for c in range(3) if c != axis]
        return " + ".join(f"{'' if b[axis] else '-'}g{k} * {' * '.join(side('uvw'[c], b[c]) for c in others)}" for k, b in enumerate(BITS))

    steps = []
    for k in range(surface.PROJECTIONS):
        steps.append(f"s{k} AS (SELECT *, {value} AS f, {slope(0)} AS fu, {slope(1)} AS fv, {slope(2)} AS fw FROM p{k})")
        move = lambda c: f"CASE WHEN fu * fu + fv * fv + fw * fw < 1e-24 THEN {c} ELSE least(1, greatest(0, {c} - f / (fu * fu + fv * fv + fw * fw) * f{c})) END AS {c}"
        steps.append(f"p{k + 1} AS (SELECT series, x, y, z, {', '.join(G)}, {', '.join(map(move, 'uvw'))} FROM s{k})")
    return f", {cells}, {some}, {begin}, {', '.join(steps)} SELECT series, x AS cx, y AS cy, z AS cz, round(x + u + 0.5, 5) AS px, round(y + v + 0.5, 5) AS py, round(z + w + 0.5, 5) AS pz FROM p{surface.PROJECTIONS}"


@query(_vertex_sql(), "solids")
def surface_vertices(spark: S, d: str) -> D:
    v = surface.mesh_vertices(surface.nets(domain(spark, d, "solids"), ISO))
    low = (1 << surface.SHIFT) - 1
    cell = [(F.shiftright("id", surface.SHIFT * k).bitwiseAND(F.lit(low)) - surface.BIAS).cast("int").alias(f"c{c}") for k, c in enumerate("xyz")]
    return v.select("series", *cell, *(F.round(c, 5).alias(f"p{c}") for c in "xyz"))


EDGE_SQL = " UNION ALL ".join(f"""SELECT a.series, '{c}' AS axis FROM solids a JOIN solids b ON b.series = a.series AND {' AND '.join(f"b.{k} = a.{k}{' + 1' if k == c else ''}" for k in 'xyz')} WHERE (a.v > {ISO}) <> (b.v > {ISO}) AND {' AND '.join(f"a.{k} BETWEEN 1 AND {n - 2}" for k, n in zip('xyz', (12, 11, 9), strict=True) if k != c)}""" for c in "xyz")


@query(f" SELECT series, count(*) * 2 AS n_triangles FROM ({EDGE_SQL}) GROUP BY 1", "solids")
def surface_triangles(spark: S, d: str) -> D:
    return surface.measures(surface.nets(domain(spark, d, "solids"), ISO)).select("series", "n_triangles")


@query(f" SELECT series, count(*) AS n_quads FROM ({EDGE_SQL}) GROUP BY 1", "solids")
def mask_surface(spark: S, d: str) -> D:
    mask = domain(spark, d, "solids").withColumn("v", (F.col("v") > ISO).cast("double"))
    return surface.mask_nets(mask, iterations=4).groupBy("series").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n_quads"))


PAINTED = "p AS (SELECT series, x, y, z FROM solids WHERE v > 0 AND z % 3 = 0)"
FILL_SQL = f""", {PAINTED}, b AS (SELECT series, greatest(0, min(x) - 2) AS u0, least(11, max(x) + 2) AS u1, greatest(0, min(y) - 2) AS v0, least(10, max(y) + 2) AS v1 FROM p GROUP BY 1), ks AS (SELECT DISTINCT series, z FROM p),
  k AS (SELECT series, z, lag(z) OVER w AS za, lead(z) OVER w AS z1, lead(z, 2) OVER w AS zb FROM ks WINDOW w AS (PARTITION BY series ORDER BY z)),
  g AS (SELECT b.series, ks.z, s.x, s.y, p.series IS NOT NULL AS i FROM b JOIN ks USING (series) JOIN (SELECT DISTINCT x, y FROM solids) s ON s.x BETWEEN u0 AND u1 AND s.y BETWEEN v0 AND v1 LEFT JOIN p ON p.series = b.series AND p.z = ks.z AND p.x = s.x AND p.y = s.y),
  f AS (SELECT a.series, a.z, a.x, a.y, any_value(a.i) AS i, min((a.x - o.x) ** 2 * 0.64 + (a.y - o.y) ** 2) AS d2, max((abs(a.x - o.x) = 1 AND a.y = o.y)::INT) AS nx, max((abs(a.y - o.y) = 1 AND a.x = o.x)::INT) AS ny FROM g a JOIN g o ON o.series = a.series AND o.z = a.z AND o.i <> a.i GROUP BY 1, 2, 3, 4),
  m AS (SELECT series, z, x, y, (CASE WHEN i THEN -1 ELSE 1 END) * CASE WHEN nx = 1 AND ny = 1 THEN 0.4 * 0.5 / sqrt(0.4 * 0.4 + 0.5 * 0.5) WHEN nx = 1 THEN 0.4 WHEN ny = 1 THEN 0.5 ELSE sqrt(d2) - 0.4 END AS d FROM f),
  h AS (SELECT k.series, k.z AS k0, k.z1, coalesce(za, k.z) AS ka, coalesce(zb, z1) AS kb, s.z, (s.z - k.z) * 1.0 / (z1 - k.z) AS t FROM k JOIN (SELECT DISTINCT z FROM solids) s ON s.z > k.z AND s.z < k.z1),
  c AS (SELECT h.series, h.z, m0.x, m0.y, m0.d AS d0, m1.d AS d1, m0.d * (2 * t ** 3 - 3 * t ** 2 + 1) + (m1.d - ma.d) * (t ** 3 - 2 * t ** 2 + t) * (z1 - k0) / (z1 - ka) + m1.d * (3 * t ** 2 - 2 * t ** 3) + (mb.d - m0.d) * (t ** 3 - t ** 2) * (z1 - k0) / (kb - k0) AS d
    FROM h JOIN m m0 ON m0.series = h.series AND m0.z = k0 JOIN m m1 ON m1.series = h.series AND m1.z = z1 AND m1.x = m0.x AND m1.y = m0.y JOIN m ma ON ma.series = h.series AND ma.z = ka AND ma.x = m0.x AND ma.y = m0.y JOIN m mb ON mb.series = h.series AND mb.z = kb AND mb.x = m0.x AND mb.y = m0.y)
  SELECT series, x, y, z, CAST(1 AS INT) AS label FROM c WHERE least(d, greatest(d0, d1)) < -1e-9"""


@query(FILL_SQL, "solids")
def fill_between_slices(spark: S, d: str) -> D:
    painted = domain(spark, d, "solids").filter("v > 0 and z % 3 = 0").select("series", "x", "y", "z", F.lit(1).alias("label"))
    return slicefill.fill_between(painted, (12, 11, 9), (0.8, 1.0, 2.5))


def _dot_sql(p: list[str], q: list[str]) -> str:
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(p, q, strict=True)) + ")"


def _distance_sql() -> str:
    at = lambda k: [f'"{k}{c}"' for c in "xyz"]
    sub = lambda p, q: [f"{a} - {b}" for a, b in zip(p, q, strict=True)]
    cross = lambda p, q: [f"({p[i]}) * ({q[j]}) - ({p[j]}) * ({q[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    n = at("n")
    over = " AND ".join(f"{_dot_sql(cross(sub(at(v), at(u)), sub(at('p'), at(u))), n)} >= 0" for u, v in ("ab", "bc", "ca"))

    def edge(u: str, v: str) -> str:
        d = sub(at(v), at(u))
        t = f"least(1, greatest(0, {_dot_sql(sub(at('p'), at(u)), d)} / {_dot_sql(d, d)}))"
        off = [f"{p} - ({a} + {t} * ({x}))" for p, a, x in zip(at("p"), at(u), d, strict=True)]
        return _dot_sql(off, off)

    rows = f"w AS (SELECT s.point_id, px, py, pz, t.* EXCLUDE (series), {', '.join(f'{x} AS n{c}' for c, x in zip('xyz', cross(sub(at('b'), at('a')), sub(at('c'), at('a'))), strict=True))} FROM spots s JOIN triangles t ON t.series = s.series)"
    face = f"{_dot_sql(sub(at('p'), at('a')), n)} ** 2 / {_dot_sql(n, n)}"
    nearest = f"nearest AS (SELECT point_id, min(CASE WHEN {_dot_sql(n, n)} > 0 AND {over} THEN {face} ELSE least({', '.join(edge(*e) for e in ('ab', 'bc', 'ca'))}) END) AS d2 FROM w GROUP BY 1)"
    return f", {rows}, {nearest} SELECT s.point_id, round(least(6.0, coalesce(sqrt(d2), 6.0)), 6) AS distance FROM spots s LEFT JOIN nearest USING (point_id)"


@query(_distance_sql(), "spots", "triangles")
def surface_distances(spark: S, d: str) -> D:
    out = meshes.surface_distance(domain(spark, d, "spots"), domain(spark, d, "triangles"), 6.0)
    return out.select("point_id", F.round("distance", 6).alias("distance"))


@query(""", q AS (SELECT s_suppkey AS query_id, CAST(s_suppkey % 4 AS INT) AS series, s_suppkey % 59 + 0.3 AS qx, CASE WHEN s_suppkey % 5 = 0 THEN 900.0 ELSE s_nationkey + 0.6 END AS qy, (s_suppkey % 13) / 1.7 AS qz FROM triangles JOIN (SELECT s_suppkey, s_nationkey FROM supplier) ON s_suppkey = tri)
  SELECT query_id, round(min((qx - px) ** 2 + (qy - py) ** 2 + (qz - pz) ** 2), 6) AS d2 FROM q JOIN spots USING (series) GROUP BY 1""", "triangles", "spots")
def nearest_spots(spark: S, d: str) -> D:
    k = F.col("tri")
    q = domain(spark, d, "triangles").select(k.alias("query_id"), "series", (k % 59 + 0.3).alias("qx"), F.when(k % 5 == 0, 900.0).otherwise(F.col("ay") + 0.6).alias("qy"), (k % 13 / 1.7).alias("qz"))
    return meshes.nearest_points(q, domain(spark, d, "spots"), 3.0).select("query_id", F.round("d2", 6).alias("d2"))


FIT = ((0.9, -0.3, 0.2), (12.0, -3.0, 40.0), 1.25)


def _turn() -> tuple[list[list[float]], tuple[float, float, float]]:
    """1.25 times the rotation of a unit quaternion (0.8, 0.48, 0.36, 0.0), and a shift."""
    w, x, y, z = 0.8, 0.48, 0.36, 0.0
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return [[FIT[2] * v for v in row] for row in r], FIT[1]


M, SHIFT = _turn()
FIT_SQL = " UNION ALL ".join(f"SELECT {r} AS r, {c} AS c, round({v!r}, 6) AS value FROM (SELECT count(*) AS n FROM spots) WHERE n > 2" for r, row in enumerate(M) for c, v in enumerate([*row, SHIFT[r]]))


@query(" " + FIT_SQL, "spots")
def fitted_similarity(spark: S, d: str) -> D:
    """The similarity that the points were moved by is found again from the pairs."""
    spots = domain(spark, d, "spots")
    y = {f"y{c}": sum((F.col(f"p{k}") * M[i][j] for j, k in enumerate("xyz")), F.lit(SHIFT[i])) for i, c in enumerate("xyz")}
    m, t = meshes.similarity_fit(spots.select(*(F.col(f"p{c}").alias(f"x{c}") for c in "xyz"), *(v.alias(k) for k, v in y.items())))
    return spark.createDataFrame([(r, c, round(float(v), 6)) for r in range(3) for c, v in enumerate([*m[r], t[r]])], "r int, c int, value double")


NEAR = 0.998, 0.03


@query(f" SELECT axis, round({NEAR[0]}, 6) AS scale, round({NEAR[1]}, 6) AS shift FROM (SELECT unnest(range(0, 3)) AS axis) WHERE (SELECT count(*) FROM spots) > 2", "spots")
def iterated_similarity(spark: S, d: str) -> D:
    """Points that were shrunk and shifted by little find each other without being told which belong together."""
    spots = domain(spark, d, "spots").dropDuplicates(["series", "px", "py", "pz"]).withColumnRenamed("series", "anchor")
    goal = spots.select("anchor", "point_id", *((F.col(f"p{c}") * NEAR[0] + NEAR[1]).alias(f"p{c}") for c in "xyz"))
    m, t = meshes.icp_similarity(spots, goal, 2.0, iterations=10, still=1e-7)
    return spark.createDataFrame([(k, round(float(m[k, k]), 6), round(float(t[k]), 6)) for k in range(3)], "axis bigint, scale double, shift double")


WINDOWS = (60.0, 10.0), (50.0, 5.0)
GREY = "least(255, greatest(0, floor(({v} - ({c} - {w} / 2.0)) / {w} * 255 + 0.5)))"
BELOW, ABOVE = (GREY.format(v=v, w=w, c=c) for v, (w, c) in zip(("b.v", "o.v"), WINDOWS, strict=True))
FUSED = """, o AS (SELECT series, x / 2 AS x, y / 2 AS y, z / 2 AS z, -v AS v FROM (SELECT * FROM solids) WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0)
  SELECT b.series, b.x AS u, b.y AS v, CAST(greatest(0, least(255, floor({grey} + 0.5))) AS INT) AS grey FROM solids b JOIN o ON o.series = b.series AND o.x = least(5, floor(b.x * 6 / 12.0 + 0.5)) AND o.y = least(5, floor(b.y * 6 / 11.0 + 0.5)) AND o.z = least(4, floor(4 * 5 / 9.0 + 0.5)) WHERE b.z = 4"""


def _fused(spark: S, d: str, **how: object) -> D:
    base_ = domain(spark, d, "solids")
    even = base_.filter("x % 2 = 0 and y % 2 = 0 and z % 2 = 0").select("series", *((F.col(c) / 2).cast("int").alias(c) for c in "xyz"), (-F.col("v")).alias("v"))
    return voxels.fuse_slices(base_, even, (12, 11, 9), (6, 6, 5), "axial", 4, *WINDOWS, **how)


@query(FUSED.format(grey=f"CASE WHEN (b.x // 3 + b.y // 3) % 2 = 1 THEN {ABOVE} ELSE {BELOW} END"), "solids")
def fused_checker(spark: S, d: str) -> D:
    return _fused(spark, d, mode="checker", checker=3)


@query(FUSED.format(grey=f"{BELOW} * 0.75 + {ABOVE} * 0.25"), "solids")
def fused_alpha(spark: S, d: str) -> D:
    return _fused(spark, d, mode="alpha", alpha=0.25)


@query(FUSED.format(grey="127.5 + (o.v - b.v) / 30.0 * 127.5"), "solids")
def fused_difference(spark: S, d: str) -> D:
    return _fused(spark, d, mode="subtract")


#: Affines by the remainder of a series: straight, slices across the body, turned and tilted a little.
AFFINES = [
    [[-1.0, 0, 0, 5], [0, -1.0, 0, 6], [0, 0, 2.0, 7]],
    [[0, 0, 3.0, 0], [-0.5, 0, 0, 1], [0, 0.5, 0, 2]],
    [[0.9, -0.1, 0, -4], [0.1, 0.9, 0.1, 8], [0, -0.1, 1.5, 9]],
]
#: What they mean: canonical axis t is voxel axis perm[t], backwards where flip[t].
ORDERS = ((0, 1, 2), (0, 0, 0)), ((2, 0, 1), (1, 0, 0)), ((0, 1, 2), (1, 1, 0))
MOVED_SQL = ", ".join(
    "CASE series % 3 " + " ".join(f"WHEN {k} THEN {f'{(12, 11, 9)[perm[t]] - 1} - ' if flip[t] else ''}{'xyz'[perm[t]]}" for k, (perm, flip) in enumerate(ORDERS)) + f" END AS {c}" for t, c in enumerate("xyz")
)


def _oriented(spark: S, d: str) -> tuple[D, Column]:
    rows = domain(spark, d, "solids")
    affines = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in a)) for a in AFFINES))
    headers = rows.select("series").distinct().withColumn("affine", F.get(affines, (F.col("series") % 3).cast("int")))
    return rows.join(orientation.oriented(headers).select("series", "orientation"), "series"), F.array(*map(F.lit, (12, 11, 9)))


@query(f" SELECT series, {MOVED_SQL}, v FROM solids", "solids")
def canonical_voxels(spark: S, d: str) -> D:
    placed, dims = _oriented(spark, d)
    return placed.select("series", *(c.alias(n) for n, c in zip("xyz", orientation.to_canonical(*map(F.col, "xyz"), dims, F.col("orientation")), strict=True)), "v")


@query(" SELECT series, x, y, z, v FROM solids", "solids")
def voxels_there_and_back(spark: S, d: str) -> D:
    placed, dims = _oriented(spark, d)
    there = placed.select("series", "orientation", *(c.alias(n) for n, c in zip("xyz", orientation.to_canonical(*map(F.col, "xyz"), dims, F.col("orientation")), strict=True)), "v")
    return there.select("series", *(c.alias(n) for n, c in zip("xyz", orientation.from_canonical(*map(F.col, "xyz"), dims, F.col("orientation")), strict=True)), "v")


@query(""" SELECT point_id AS segment_id, false AS crosses FROM spots WHERE px > 60 UNION ALL SELECT point_id, max((t > 0 AND t < l AND u BETWEEN 0 AND 1 AND v >= 0 AND u + v <= 1)::INT) = 1 FROM (
  SELECT point_id, l, (sx * hx + sy * hy + sz * hz) / det AS u, (dx * rx + dy * ry + dz * rz) / det AS v, (fx * rx + fy * ry + fz * rz) / det AS t FROM (SELECT *, sy * ez - sz * ey AS rx, sz * ex - sx * ez AS ry, sx * ey - sy * ex AS rz, nullif(ex * hx + ey * hy + ez * hz, 0) AS det FROM (
  SELECT *, dy * fz - dz * fy AS hx, dz * fx - dx * fz AS hy, dx * fy - dy * fx AS hz FROM (SELECT point_id, 12.0 AS l, 0.6 AS dx, 0.8 AS dy, 0.0 AS dz, bx - ax AS ex, "by" - ay AS ey, bz - az AS ez, cx - ax AS fx, cy - ay AS fy, cz - az AS fz, px - ax AS sx, py - ay AS sy, pz - az AS sz FROM spots s LEFT JOIN triangles t USING (series))))) GROUP BY 1""", "spots", "triangles")
def crossing_segments(spark: S, d: str) -> D:
    s = domain(spark, d, "spots").select("series", F.col("point_id").alias("segment_id"), "px", "py", "pz", *(F.lit(v).alias(k) for k, v in (("dx", 0.6), ("dy", 0.8), ("dz", 0.0), ("l", 12.0))))
    return meshes.crossings(s, domain(spark, d, "triangles"), 4.0).select("segment_id", "crosses")


@query(f"{_vertex_sql().rsplit(' SELECT series, x AS cx', 1)[0]} SELECT series, count(*) AS n_vertices FROM p0 GROUP BY 1", "solids")
def smoothed_vertices(spark: S, d: str) -> D:
    mesh = surface.nets(domain(spark, d, "solids"), ISO)
    return smoothing.corners(smoothing.smooth(mesh, 0.3, 4, preserve_volume=False), ["series"]).groupBy("series").agg(F.count("*").alias("n_vertices"))

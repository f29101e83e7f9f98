"""Triangle meshes (mesh, ax..cz) and point sets as tables: distances, crossings, even samples, similarity fits.

Nearest neighbours are equi-joins on grid cells with rings that grow until the best so far cannot be beaten; fits are closed
forms over sums that merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, dealt

V3 = tuple[Column, Column, Column]


def place(k: str) -> V3:
    return tuple(F.col(f"{k}{c}") for c in "xyz")


def _sub(p: V3, q: V3) -> V3:
    return tuple(a - b for a, b in zip(p, q, strict=True))


def _dot(p: V3, q: V3) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def _cross(p: V3, q: V3) -> V3:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def _along(a: V3, s: Column, d: V3) -> V3:
    return tuple(x + s * y for x, y in zip(a, d, strict=True))


SIDES = "ab", "bc", "ca"


def squared_distance(rows: DataFrame, point: str = "p") -> DataFrame:
    """rows (a point px, py, pz and a triangle ax..cz) with d2, the squared distance: to the face where the point lies over it,
    else to the nearest of the three edges.

    Each step is a column of its own: nested in one another, the steps are repeated where they are used, and make code that
    the JVM does not compile."""
    kept, p, n = rows.columns, place(point), place("_n")
    step = lambda k, v: {f"{k}{c}": x for c, x in zip("xyz", v, strict=True)}
    ways = {k: x for u, v in SIDES for k, x in (step(f"_w{u}", _sub(p, place(u))) | step(f"_{u}{v}", _sub(place(v), place(u)))).items()}
    rows = rows.withColumns(step("_n", _cross(_sub(place("b"), place("a")), _sub(place("c"), place("a")))) | ways)
    dots = {k: x for u, v in SIDES for k, x in ((f"_s{u}", _dot(_cross(place(f"_{u}{v}"), place(f"_w{u}")), n)), (f"_l{u}", _dot(place(f"_{u}{v}"), place(f"_{u}{v}"))), (f"_t{u}", _dot(place(f"_w{u}"), place(f"_{u}{v}"))))}
    rows = rows.withColumns({"_nn": _dot(n, n), "_h": _dot(place("_wa"), n)} | dots)
    rows = rows.withColumns({f"_t{u}": F.when(F.col(f"_l{u}") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"_t{u}") / F.col(f"_l{u}")))).otherwise(0.0) for u, _ in SIDES})
    rows = rows.withColumns({k: x for u, v in SIDES for k, x in step(f"_o{u}", _sub(p, _along(place(u), F.col(f"_t{u}"), place(f"_{u}{v}")))).items()})
    rows = rows.withColumns({f"_e{u}": _dot(place(f"_o{u}"), place(f"_o{u}")) for u, _ in SIDES})
    over = (F.col("_nn") > 0) & (F.col("_sa") >= 0) & (F.col("_sb") >= 0) & (F.col("_sc") >= 0)
    return rows.withColumn("d2", F.when(over, F.col("_h") * F.col("_h") / F.col("_nn")).otherwise(F.least("_ea", "_eb", "_ec"))).select(*(c for c in kept if c != "d2"), "d2")


def _cells(low: list[Column], high: list[Column], size: float) -> list[Column]:
    """One array of cell numbers for each axis."""
    return [F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in zip(low, high, strict=True)]


def _spread(rows: DataFrame, cells: list[Column]) -> DataFrame:
    for c, numbers in zip("xyz", cells, strict=True):
        rows = rows.withColumn(f"_c{c}", F.explode(numbers))
    return rows


CELL = ["_cx", "_cy", "_cz"]


CORNERS = [f"{k}{c}" for k in "abc" for c in "xyz"]


def _box() -> tuple[list[Column], list[Column]]:
    """The least and greatest corner of a triangle's box."""
    low, high = ([f(*(F.col(f"{k}{c}") for k in "abc")) for c in "xyz"] for f in (F.least, F.greatest))
    return low, high


def surface_distance(points: DataFrame, triangles: DataFrame, reach: float, by: tuple[str, ...] = ("series",), levels: int = 3) -> DataFrame:
    """points (by, point_id, px, py, pz) with distance: to the nearest triangle of the same by within reach; farther reads as reach.

    Cells that hold points keep the triangles that can be nearest to a place in them: those no farther from the centre of the
    box around the cell's places than the nearest one and the box's diagonal.  The first cells are as wide as the reach; each
    level halves them and looks among the triangles of the cell above, so that a point at last meets a short list.  Points
    at one place ask once, equal triangles answer once."""
    place_of, cell = [*by, "px", "py", "pz"], [*by, *CELL]
    places = cut(points.select(*place_of).distinct())
    low, high = _box()
    laid = None
    for k in range(levels):
        size = reach / 2**k
        if laid is None:
            ranges = dict(zip(("_sx", "_sy", "_sz"), _cells([c - reach for c in low], [c + reach for c in high], size), strict=True))
            laid = dealt(triangles.select(*by, *CORNERS).distinct().withColumns({**ranges, "_near": F.lit(float(reach))}))
            laid = _spread(laid, [F.col(c) for c in ranges]).drop(*ranges)
        else:
            for c in CELL:
                laid = laid.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
        ends = places.groupBy(*by, *(F.floor(F.col(f"p{c}") / size).alias(f"_c{c}") for c in "xyz")).agg(*(f(f"p{c}").alias(f"_{e}{c}") for c in "xyz" for e, f in (("l", F.min), ("h", F.max))))
        held = ends.select(*cell, *((F.col(f"_l{c}") / 2 + F.col(f"_h{c}") / 2).alias(f"_o{c}") for c in "xyz"), _radius().alias("_r"))
        # Exploded, the distance is worked out before the filter, which would else repeat its steps within one another.
        off = squared_distance(laid.join(held, cell), "_o").withColumn("_off", F.explode(F.array(F.sqrt("d2"))))
        off = cut(off.filter(F.col("_off") <= F.col("_near") + F.col("_r")).select(*cell, *CORNERS, "_r", "_off"))
        least = off.groupBy(*cell).agg(F.least(F.lit(float(reach)), F.min("_off") * (1 + 1e-9) + F.first("_r")).alias("_near"))
        laid = off.join(least, cell).filter(F.col("_off") <= F.col("_near") + F.col("_r")).select(*cell, *CORNERS, "_near")
        laid = dealt(laid, *(cell if k == levels - 1 else []))
    asked = places.withColumns({f"_c{c}": F.floor(F.col(f"p{c}") / size) for c in "xyz"})
    hits = squared_distance(dealt(asked, *cell).join(laid.hint("merge"), cell)).groupBy(*place_of).agg(F.min("d2").alias("d2"))
    found = points.select(*by, "point_id", "px", "py", "pz").join(hits, place_of, "left")
    return found.select(*by, "point_id", F.least(F.lit(float(reach)), F.coalesce(F.sqrt("d2"), F.lit(float(reach)))).alias("distance"))


def _radius() -> Column:
    """Half the diagonal of a box from _lx, _ly, _lz to _hx, _hy, _hz, and what rounding can take away."""
    sides = [F.col(f"_h{c}") - F.col(f"_l{c}") for c in "xyz"]
    return F.sqrt(_dot(sides, sides)) / 2 * (1 + 1e-6) + 1e-12 * F.greatest(*(F.abs(f"_{e}{c}") for e in "lh" for c in "xyz"))


def crossings(segments: DataFrame, triangles: DataFrame, cell: float, by: tuple[str, ...] = ("series",), skip: float = 0.0) -> DataFrame:
    """segments (by, segment_id, px, py, pz to qx, qy, qz) with crosses: whether one crosses a triangle more than skip from its start.

    Rays may be given instead: by a unit direction dx, dy, dz and a length l in place of the end, which are then taken as they
    are.  A segment lies in the cells that it passes, a triangle in those of its box that its plane cuts; a semi-join in a cell
    ends at the first crossing.  Equal segments ask once."""
    p = place("p")
    if "l" in segments.columns:
        way = [*by, "px", "py", "pz", "dx", "dy", "dz", "l"]
        rows = segments.select(*way).distinct().withColumn("_l", F.col("l").cast("double")).withColumns({f"_d{c}": F.col(f"d{c}").cast("double") for c in "xyz"})
    else:
        way = [*by, "px", "py", "pz", "qx", "qy", "qz"]
        q = place("q")
        rows = segments.select(*way).distinct().withColumn("_l", F.sqrt(_dot(_sub(q, p), _sub(q, p))))
        rows = rows.withColumns({f"_d{c}": x / F.col("_l") for c, x in zip("xyz", _sub(q, p), strict=True)})
    slack = cell * 1e-6
    low, high = _box()
    laid = _spread(dealt(triangles.select(*by, *CORNERS)), _cells([c - slack for c in low], [c + slack for c in high], cell))
    a, b, c = place("a"), place("b"), place("c")
    n, centre = _cross(_sub(b, a), _sub(c, a)), tuple((F.col(k) + 0.5) * cell for k in CELL)
    wide = sum((F.abs(x) * (cell / 2 + slack + 1e-9 * F.abs(y)) for x, y in zip(n, _sub(centre, a), strict=True)), F.lit(0.0))
    laid = laid.filter(F.abs(_dot(_sub(centre, a), n)) <= wide)

    rows = rows.filter(F.col("_l") > skip)
    steps = F.ceil(F.col("_l") / (cell / 2)).cast("int")
    rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1)))
    ends = [[F.col(f"p{x}") + (F.col("_t") + k) * F.col("_l") / steps * F.col(f"_d{x}") for x in "xyz"] for k in (0, 1)]
    between = [[f(u, v) + s for u, v in zip(*ends, strict=True)] for f, s in ((F.least, -slack), (F.greatest, slack))]
    asked = _spread(rows, _cells(*between, cell)).drop("_t").distinct()
    d = place("_d")
    e1, e2 = _sub(b, a), _sub(c, a)
    h = _cross(d, e2)
    det = _dot(e1, h)
    s = _sub(p, a)
    r = _cross(s, e1)
    u, v, t = _dot(s, h) / det, _dot(d, r) / det, _dot(e2, r) / det
    hit = (F.abs(det) >= 1e-12) & u.between(0, 1) & (v >= 0) & (u + v <= 1) & (t > skip) & (t < F.col("_l"))
    left, right = dealt(asked, *by, *CELL), dealt(laid, *by, *CELL).select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(by)), *(F.col(k).alias(f"{k}t") for k in CELL), *CORNERS)
    same = [F.col(k) == F.col(f"_by{i}") for i, k in enumerate(by)] + [F.col(k) == F.col(f"{k}t") for k in CELL]
    on = hit
    for x in same:
        on = x & on
    crossed = left.join(right.hint("merge"), on, "left_semi").select(*way).distinct().withColumn("crosses", F.lit(True))
    return segments.join(crossed, way, "left").select(*segments.columns, F.coalesce("crosses", F.lit(False)).alias("crosses"))


def surface_samples(triangles: DataFrame, step: float) -> DataFrame:
    """Points spread evenly over each triangle, about step apart: the centroids of n * n equal pieces (all further columns stay)."""
    if not step > 0:
        raise ValueError(f"mesh-step: {step}")
    a, b, c = place("a"), place("b"), place("c")
    n3 = _cross(_sub(b, a), _sub(c, a))
    piece = 3**0.5 / 4 * step * step
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.sqrt(_dot(n3, n3)) / 2 / piece)))
    rows = triangles.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1 - F.col("_i"))))
    thirds = F.when(F.col("_i") + F.col("_j") < F.col("_n") - 1, F.array(F.lit(1 / 3), F.lit(2 / 3))).otherwise(F.array(F.lit(1 / 3)))
    rows = rows.withColumn("_k", F.explode(thirds))
    u, v = (F.col("_i") + F.col("_k")) / F.col("_n"), (F.col("_j") + F.col("_k")) / F.col("_n")
    at = [((1 - u - v) * x + u * y + v * z).alias(f"p{i}") for i, x, y, z in zip("xyz", a, b, c, strict=True)]
    drop = {*(f"{k}{i}" for k in "abc" for i in "xyz"), "_n", "_i", "_j", "_k"}
    return rows.select(*(x for x in triangles.columns if x not in drop), *at)


def nearest_points(queries: DataFrame, points: DataFrame, cell: float, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Each query (by, query_id, qx, qy, qz) with its nearest point (by, point_id, px, py, pz) and d2; the least point_id among equals.

    Points at one place are one, that of the least point_id, and queries at one place ask once.  A query asks a ring of cells, then one twice as wide, and is settled when its best is nearer than the ring's edge; those
    that are farther from all points go down a pyramid of boxes (_far)."""
    at = lambda k: [F.floor(F.col(f"{k}{c}") / cell).alias(f"_c{c}") for c in "xyz"]
    at_place = [*by, "qx", "qy", "qz"]
    laid = cut(points.groupBy(*by, "px", "py", "pz").agg(F.min("point_id").alias("point_id")).select(*by, "point_id", "px", "py", "pz", *at("p")))
    asking, out = queries.select(*by, "query_id", "qx", "qy", "qz"), None
    waiting = cut(asking.groupBy(*at_place).agg(F.min("query_id").alias("query_id")).select(*by, "query_id", "qx", "qy", "qz"))
    best_of = lambda met: met.groupBy(*by, "query_id").agg(F.min(F.struct(_dot(_sub(place("q"), place("p")), _sub(place("q"), place("p"))).alias("d2"), "point_id", "px", "py", "pz")).alias("m"))
    for ring in (1, 2):
        near = [F.sequence(F.floor(F.col(f"q{c}") / cell) - ring, F.floor(F.col(f"q{c}") / cell) + ring) for c in "xyz"]
        best = cut(waiting.join(best_of(dealt(_spread(waiting, near), *by, *CELL).join(laid.hint("merge"), [*by, *CELL])), [*by, "query_id"], "left"))
        settled = F.coalesce(F.col("m.d2") <= (ring * cell) ** 2, F.lit(False))
        done = best.filter(settled)
        out = done if out is None else out.unionByName(done)
        waiting = best.filter(~settled).drop("m")
    far = _far(waiting, laid, cell, by)
    found = out if far is None else out.unionByName(waiting.join(best_of(far.join(laid, [*by, *CELL])), [*by, "query_id"]))
    return asking.join(found.drop("query_id"), at_place).select(*by, "query_id", "qx", "qy", "qz", "m.*")


def _far(queries: DataFrame, laid: DataFrame, cell: float, by: tuple[str, ...]) -> DataFrame | None:
    """The cells that can hold the nearest point of queries far from all: down a pyramid of boxes, each level twice as fine.

    A query starts with the few boxes of the top level; at each level it keeps those that are no farther than the farthest corner
    of the best one, and asks their eight parts."""
    reach = lambda rows, k: rows.agg(F.max(F.greatest(*(F.abs(f"{k}{c}") for c in "xyz")))).first()[0]
    ends = reach(queries, "q"), reach(laid, "p")
    if None in ends:
        return None
    levels = max(1, int(np.ceil(np.log2(max(*ends, cell) / cell))) + 1)
    pyramid = [cut(laid.groupBy(*by, *CELL).agg(*(f(f"p{c}").alias(f"{k}{c}") for c in "xyz" for k, f in (("l", F.min), ("h", F.max)))))]
    for _ in range(levels):
        up = pyramid[-1].select(*by, *(F.floor(F.col(c) / 2).alias(c) for c in CELL), *(f"{k}{c}" for k in "lh" for c in "xyz"))
        pyramid.append(cut(up.groupBy(*by, *CELL).agg(*(f(f"{k}{c}").alias(f"{k}{c}") for c in "xyz" for k, f in (("l", F.min), ("h", F.max))))))
    gap = [F.greatest(F.col(f"l{c}") - F.col(f"q{c}"), F.lit(0.0), F.col(f"q{c}") - F.col(f"h{c}")) for c in "xyz"]
    span = [F.greatest(F.abs(F.col(f"l{c}") - F.col(f"q{c}")), F.abs(F.col(f"q{c}") - F.col(f"h{c}"))) for c in "xyz"]
    asked = _spread(queries.select(*by, "query_id", "qx", "qy", "qz"), [F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))] * 3)  # the top level has no other cells
    for k in range(levels, -1, -1):
        met = asked.join(pyramid[k], [*by, *CELL]).withColumns({"least": sum((g * g for g in gap), F.lit(0.0)), "most": sum((s * s for s in span), F.lit(0.0))})
        met = cut(met.select(*by, "query_id", "qx", "qy", "qz", *CELL, "least", "most"))
        bound = met.groupBy(*by, "query_id").agg(F.min("most").alias("bound"))
        asked = met.join(bound, [*by, "query_id"]).filter(F.col("least") <= F.col("bound")).select(*by, "query_id", "qx", "qy", "qz", *CELL)
        if k:
            for c in CELL:
                asked = asked.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
    return asked


IDENTITY = (np.eye(3), np.zeros(3))
Fit = tuple[np.ndarray, np.ndarray]


def moment_sums(x: str = "x", y: str = "y") -> list[Column]:
    """The sums over pairs (xx, xy, xz to yx, yy, yz) from which a similarity follows; they merge."""
    one = [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(f"{k}{c}").alias(f"s{k}{c}") for k in (x, y) for c in "xyz")]
    return [*one, *(F.sum(F.col(f"{x}{a}") * F.col(f"{y}{b}")).alias(f"m{a}{b}") for a in "xyz" for b in "xyz"), F.sum(sum((F.col(f"{x}{c}") ** 2 for c in "xyz"), F.lit(0.0))).alias("square")]


def similarity_of(sums: dict[str, float], x: str = "x", y: str = "y") -> Fit:
    """(m, t) with y = m x + t best in least squares: the rotation is the top eigenvector of a symmetric 4 x 4 of the moments."""
    n = sums["n"]
    if n < 3:
        raise ValueError(f"fit-pairs: {n:.0f}")
    mx, my = (np.array([sums[f"s{k}{c}"] for c in "xyz"]) / n for k in (x, y))
    s = np.array([[sums[f"m{a}{b}"] for b in "xyz"] for a in "xyz"]) - n * np.outer(mx, my)
    spread = sums["square"] - n * mx @ mx
    if not spread > 0:
        raise ValueError("fit-pairs: no spread")
    skew = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    k = np.empty((4, 4))
    k[0, 0], k[0, 1:], k[1:, 0] = np.trace(s), skew, skew
    k[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    w, a = (q := np.linalg.eigh(k)[1][:, -1])[0], q[1:]
    cross = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    r = np.eye(3) + 2 * w * cross + 2 * cross @ cross
    m = r * (np.trace(r @ s) / spread)
    return m, my - m @ mx


def similarity_fit(pairs: DataFrame) -> Fit:
    return similarity_of({k: v or 0.0 for k, v in pairs.agg(*moment_sums()).first().asDict().items()})


def moved(points: DataFrame, fit: Fit, source: str, to: str) -> DataFrame:
    m, t = fit
    return points.withColumns({f"{to}{c}": sum((F.col(f"{source}{d}") * float(m[i, j]) for j, d in enumerate("xyz")), F.lit(float(t[i]))) for i, c in enumerate("xyz")})


def icp_similarity(source: DataFrame, target: DataFrame, cell: float, both: bool = True, start: Fit = IDENTITY, iterations: int = 40, keep: float = 0.9, by: tuple[str, ...] = ("anchor",), still: float = 1e-9) -> Fit:
    """The similarity that takes source to target (by, point_id, px, py, pz) over all anchors: pairs of nearest points (from
    both sides where both), of each anchor those up to the keep quantile of distance; refit, repeat, until it is still.

    A round is joins and two aggregates; the driver sees sixteen sums."""
    base = cut(source.select(*by, F.col("point_id").alias("query_id"), *(F.col(f"p{c}").alias(f"s{c}") for c in "xyz")))
    goal = cut(target.select(*by, "point_id", "px", "py", "pz"))
    fit = start
    for _ in range(iterations):
        now = moved(base, fit, "s", "q")
        there = nearest_points(now.drop("sx", "sy", "sz"), goal, cell, by).select(*by, "d2", "query_id", *(F.col(f"p{c}").alias(f"y{c}") for c in "xyz"))
        pairs = there
        if both:
            back = nearest_points(goal.select(*by, F.col("point_id").alias("query_id"), *(F.col(f"p{c}").alias(f"q{c}") for c in "xyz")), now.select(*by, F.col("query_id").alias("point_id"), *(F.col(f"q{c}").alias(f"p{c}") for c in "xyz")), cell, by)
            pairs = pairs.unionByName(back.select(*by, "d2", F.col("point_id").alias("query_id"), *(F.col(f"q{c}").alias(f"y{c}") for c in "xyz")))
        pairs = cut(pairs)
        limit = pairs.groupBy(*by).agg(F.percentile_approx("d2", keep, 100_000).alias("limit"))
        kept = pairs.join(limit, list(by)).filter(F.col("d2") <= F.col("limit")).join(base, [*by, "query_id"])
        new = similarity_fit(kept.select(*(F.col(f"s{c}").alias(f"x{c}") for c in "xyz"), "yx", "yy", "yz"))
        shift = max(abs(new[0] - fit[0]).max(), abs(new[1] - fit[1]).max())
        fit = new
        if shift < still:
            break
    return fit


def fit_scale(fit: Fit) -> float:
    return float(np.cbrt(np.linalg.det(fit[0])))

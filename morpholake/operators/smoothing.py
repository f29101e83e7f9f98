"""Smoothing of triangle meshes by a windowed-sinc filter: rounds of neighbour means, then each closed part gets its volume back.

A mesh is a table of triangles (by, a, b, c: its vertices' names, ax..cz: their places).  A round is one join of vertices with
their neighbours and one aggregate, over all meshes at once; rounds are written, so neither plans nor lineage grow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, cut
from .surface import area, signed_volume

VOLUME_STEPS = 4
#: A part that encloses less is a sliver; no step moves a vertex farther than the second.
LEAST_VOLUME, MOST_STEP = 1e-3, 1.0
AXES = "xyz"


def filter_weights(iterations: int, pass_band: float) -> np.ndarray:
    """Weights of the Chebyshev terms of a low-pass filter: a sinc under a Hamming window, its cut-off moved up until the gain at
    the edge of the pass band is one."""
    if iterations < 1 or int(iterations) != iterations:
        raise ValueError(f"smooth-iterations: {iterations}")
    if not 0 < pass_band < 2:
        raise ValueError(f"smooth-passband: {pass_band}")
    k = np.arange(iterations + 1)
    edge = np.arccos(1 - pass_band / 2)
    window = 0.54 + 0.46 * np.cos(k * np.pi / (iterations + 1))

    def weights(shift: float) -> np.ndarray:
        cut_off = edge + shift
        return window * np.concatenate([[cut_off / np.pi], 2 * np.sin(k[1:] * cut_off) / (k[1:] * np.pi)])

    gain = lambda shift: float(weights(shift) @ np.cos(k * edge))
    low, high = 0.0, 0.0
    while gain(high) < 1 - 1e-3 and edge + high < np.pi:
        low, high = high, min(np.pi - edge, high + np.pi / (4 * (iterations + 1)))
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if gain(middle) < 1 - 1e-3 else (low, middle)
    return weights(high)


def corners(triangles: DataFrame, by: list[str]) -> DataFrame:
    """by, id, x, y, z: every vertex once."""
    each = F.array(*(F.struct(F.col(k).alias("id"), *(F.col(f"{k}{c}").alias(c) for c in AXES)) for k in "abc"))
    return triangles.select(*by, F.explode(each).alias("v")).groupBy(*by, "v.id").agg(*(F.first(f"v.{c}").alias(c) for c in AXES))


def neighbours(triangles: DataFrame, by: list[str]) -> DataFrame:
    """by, id, next: both ends of every triangle's edges; an edge inside a surface counts twice, so all weigh alike."""
    pairs = F.array(*(F.struct(F.col(p).alias("id"), F.col(q).alias("next")) for p, q in ("ab", "bc", "ca", "ba", "cb", "ac")))
    return triangles.select(*by, F.explode(pairs).alias("e")).select(*by, "e.*")


def replaced(triangles: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """The triangles with their vertices' places taken from vertices (by, id, x, y, z)."""
    out = triangles.select(*by, "a", "b", "c")
    for k in "abc":
        out = out.join(vertices.select(*by, F.col("id").alias(k), *(F.col(c).alias(f"{k}{c}") for c in AXES)), [*by, k])
    return out


def filtered(vertices: DataFrame, links: DataFrame, weights: np.ndarray, by: list[str]) -> DataFrame:
    """vertices after the filter: T0 = x, T1 = half a step to the neighbours' mean, Tj = 2 half(Tj-1) - Tj-2, summed by weights."""
    links = cut(links)
    w = [float(x) for x in weights]
    state = cut(vertices.select(*by, "id", *(F.col(c).alias(f"t{c}") for c in AXES), *(F.lit(0.0).alias(f"p{c}") for c in AXES), *((F.col(c) * w[0]).alias(f"s{c}") for c in AXES)))
    for j in range(1, len(w)):
        near = links.join(state.select(*by, F.col("id").alias("next"), *(f"t{c}" for c in AXES)), [*by, "next"])
        means = near.groupBy(*by, "id").agg(*(F.avg(f"t{c}").alias(f"m{c}") for c in AXES))
        half = {c: (F.col(f"t{c}") + F.col(f"m{c}")) / 2 for c in AXES}
        new = half if j == 1 else {c: 2 * half[c] - F.col(f"p{c}") for c in AXES}
        joined = state.join(means, [*by, "id"])
        state = cut(joined.select(*by, "id", *(new[c].alias(f"t{c}") for c in AXES), *(F.col(f"t{c}").alias(f"p{c}") for c in AXES), *((F.col(f"s{c}") + w[j] * new[c]).alias(f"s{c}") for c in AXES)))
    return state.select(*by, "id", *(F.col(f"s{c}").alias(c) for c in AXES))


def parts(triangles: DataFrame, by: list[str]) -> DataFrame:
    """by, id, part, closed: connected parts; one is closed when each of its edges belongs to an even number of triangles."""
    node = lambda k: F.struct(*by, F.col(k).alias("id"))
    vertices = corners(triangles, by).select(node("id").alias("node"))
    comp = cut(components(vertices, cut(neighbours(triangles, by).select(node("id").alias("a"), node("next").alias("b")).distinct())))
    own = comp.select(*(F.col(f"node.{b}").alias(b) for b in by), F.col("node.id").alias("id"), F.col("component").alias("part"))
    edges = neighbours(triangles, by).filter("id < next").groupBy(*by, "id", "next").agg(F.count(F.lit(1)).alias("n"))
    open_ = edges.filter("n % 2 = 1").join(own, [*by, "id"]).select("part").distinct().withColumn("_open", F.lit(True))
    return own.join(open_, "part", "left").select(*by, "id", "part", F.col("_open").isNull().alias("closed"))


def smooth(triangles: DataFrame, strength: float, iterations: int = 20, preserve_volume: bool = True, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """The triangles (by, a, b, c, ax..cz) with their vertices smoothed: strength 0 leaves all, 1 is the most.

    With preserve_volume each closed part moves along its vertices' normals until it encloses what it did before."""
    if not 0 <= strength <= 1:
        raise ValueError(f"smooth-strength: {strength}")
    keys = list(by)
    mesh = cut(triangles.select(*keys, "a", "b", "c", *(f"{k}{c}" for k in "abc" for c in AXES)))
    if strength == 0:
        return mesh
    moved = filtered(corners(mesh, keys), neighbours(mesh, keys), filter_weights(iterations, 10 ** (-4 * strength)), keys)
    if preserve_volume:
        owner = cut(parts(mesh, keys))
        of = owner.select(*keys, F.col("id").alias("a"), "part", "closed")
        before = cut(mesh.join(of.filter("closed"), [*keys, "a"]).groupBy("part").agg(F.sum(signed_volume()).alias("before")).filter(F.abs("before") >= LEAST_VOLUME))
        for _ in range(VOLUME_STEPS):
            now = cut(replaced(mesh, moved, keys))
            size = now.join(of, [*keys, "a"]).groupBy("part").agg(F.sum(signed_volume()).alias("volume"), F.sum(area()).alias("area"))
            step = size.join(before, "part").filter("area > 1e-12").select("part", F.greatest(F.lit(-MOST_STEP), F.least(F.lit(MOST_STEP), (F.col("before") - F.col("volume")) / F.col("area"))).alias("step"))
            u, v = ([F.col(f"{k}{c}") - F.col(f"a{c}") for c in AXES] for k in "bc")
            normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
            normals = now.select(*keys, F.explode(F.array("a", "b", "c")).alias("id"), *(n.alias(f"n{c}") for n, c in zip(normal, AXES, strict=True))).groupBy(*keys, "id").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in AXES))
            length = F.sqrt(sum((F.col(f"n{c}") ** 2 for c in AXES), F.lit(0.0)))
            far = F.coalesce("step", F.lit(0.0)) / F.when(length > 0, length).otherwise(1.0)
            joined = moved.join(normals, [*keys, "id"]).join(owner.select(*keys, "id", "part"), [*keys, "id"]).join(step, "part", "left")
            moved = cut(joined.select(*keys, "id", *((F.col(c) + far * F.col(f"n{c}")).alias(c) for c in AXES)))
    return replaced(mesh, moved, keys)

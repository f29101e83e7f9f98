"""Structures painted every few slices, filled between them: exact distance maps of slices and a cubic through all of them.

A slice is one group, so a volume spreads over tasks by slices; what passes between them is a distance map per painted slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = "xyz"
#: The two axes within a slice, by the axis across.
ACROSS = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}
#: Pixels around a structure's box, so that every slice has an outside.
MARGIN = 2
FAR = 1e15


def _lower_envelope(f: np.ndarray, step: float) -> np.ndarray:
    """min over k of f[k] + (step * (q - k))^2 for every q, along the first axis, all columns side by side.

    A column keeps a stack of parabolas that are lowest somewhere, and from where on each is."""
    n, width = f.shape
    col = np.arange(width)
    tops = np.zeros((n, width), np.int64)  # which parabola
    start = np.full((n + 1, width), np.inf)
    start[0] = -np.inf
    k = np.zeros(width, np.int64)
    square = step * step
    for q in range(1, n):
        todo = np.ones(width, bool)
        while True:
            v = tops[k, col]
            meet = ((f[q] + square * q * q) - (f[v, col] + square * v * v)) / (2 * square * (q - v))
            todo = (meet <= start[k, col]) & (k > 0)
            if not todo.any():
                break
            k = k - todo
        lower = meet <= start[k, col]  # only where the stack is at its bottom
        k = np.where(lower, k, k + 1)
        tops[k, col] = q
        start[k, col] = np.where(lower, -np.inf, meet)
        start[k + 1, col] = np.inf
    out = np.empty_like(f)
    k = np.zeros(width, np.int64)
    for q in range(n):
        while True:
            later = start[k + 1, col] < q
            if not later.any():
                break
            k = k + later
        v = tops[k, col]
        out[q] = f[v, col] + square * (q - v) ** 2
    return out


def distances(on: np.ndarray, steps: tuple[float, float]) -> np.ndarray:
    """Squared distance of every pixel to the nearest one that is on, over FAR / 2 where none is: one axis after the other."""
    across = _lower_envelope(np.where(on, 0.0, FAR), steps[0])
    return _lower_envelope(np.ascontiguousarray(across.T), steps[1]).T


def signed_distances(inside: np.ndarray, steps: tuple[float, float]) -> np.ndarray:
    """Distance to the edge, negative inside; the edge runs midway between pixel centres, exactly so beside it."""
    near = []
    for axis, step in enumerate(steps):
        differs = np.zeros_like(inside)
        edge = np.diff(inside, axis=axis)
        low, high = [slice(None)] * 2, [slice(None)] * 2
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        differs[tuple(low)] |= edge
        differs[tuple(high)] |= edge
        near.append(np.where(differs, step / 2, np.inf))
    a, b = near
    with np.errstate(invalid="ignore"):
        beside = np.where(np.isinf(a), b, np.where(np.isinf(b), a, a * b / np.hypot(np.where(np.isinf(a), 1, a), np.where(np.isinf(b), 1, b))))
    far = np.sqrt(np.where(inside, distances(~inside, steps), distances(inside, steps))) - min(steps) / 2
    return np.where(inside, -1, 1) * np.where(np.isinf(beside), far, beside)


def sparsest_axis(mask: DataFrame) -> DataFrame:
    """(series, axis): the axis with the largest share of empty slices between painted ones, over all labels; z before y
    before x among equals, z without any gap."""
    spans = mask.groupBy("series", "label").agg(*(F.count_distinct(c).alias(f"on_{c}") for c in AXES), *((F.max(c) - F.min(c) + 1).alias(f"span_{c}") for c in AXES))
    share = lambda c: (F.sum(f"span_{c}") - F.sum(f"on_{c}")) / F.sum(f"span_{c}")
    rows = spans.groupBy("series").agg(*(share(c).alias(c) for c in AXES))
    return rows.select("series", F.when((F.col("x") > F.col("y")) & (F.col("x") > F.col("z")), "x").when(F.col("y") > F.col("z"), "y").otherwise("z").alias("axis"))


def _groups(parts: pd.DataFrame) -> pd.DataFrame:
    """The labels of one volume (255 at most) with their group: those that overlap and share their painted slices."""
    parts = parts.sort_values("label", ignore_index=True)
    keys = [sorted(k) for k in parts["keys"]]
    boxes = parts[["u0", "u1", "v0", "v1"]].to_numpy()
    root = list(range(len(parts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            a, b = boxes[i], boxes[j]
            low, high = max(keys[i][0], keys[j][0]), min(keys[i][-1], keys[j][-1])
            meet = a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3] and low <= high
            if meet and [k for k in keys[i] if low <= k <= high] == [k for k in keys[j] if low <= k <= high]:
                root[find(j)] = find(i)
    parts["grp"] = [int(parts["label"][find(i)]) for i in range(len(parts))]
    return parts[["series", "label", "grp", "keys", "u0", "u1", "v0", "v1"]]


def fill_between(mask: DataFrame, dims: tuple[int, int, int], spacing: tuple[float, float, float], axis: str | None = None) -> DataFrame:
    """(series, x, y, z, label) of the voxels that fill the empty slices between painted ones; painted voxels stay as they are.

    mask has the labelled voxels (series, x, y, z, label).  axis: the one across the slices, else each volume's sparsest.
    Labels painted together are one shape whose voxels take the label that they are deepest in; where fills meet, the deeper
    one stays."""
    size, step = dict(zip(AXES, dims, strict=True)), dict(zip(AXES, spacing, strict=True))
    chosen = mask.select("series").distinct().withColumn("axis", F.lit(axis)) if axis else sparsest_axis(mask)
    pick = lambda which: F.coalesce(*(F.when(F.col("axis") == a, F.col(ACROSS[a][which] if which < 2 else a)) for a in AXES))
    pixels = mask.join(F.broadcast(chosen), "series").select("series", "axis", "label", pick(0).alias("u"), pick(1).alias("v"), pick(2).alias("s"))  # a row per volume is broadcast, if Spark finds it small
    most = lambda which: F.coalesce(*(F.when(F.col("axis") == a, F.lit(size[ACROSS[a][which]])) for a in AXES))
    boxes = pixels.groupBy("series", "axis", "label").agg(F.sort_array(F.collect_set("s")).alias("keys"), *(f(c).alias(f"{c}{k}") for c in "uv" for k, f in enumerate((F.min, F.max))))
    boxes = boxes.select("series", "axis", "label", "keys", *(F.greatest(F.lit(0), F.col(f"{c}0") - MARGIN).cast("int").alias(f"{c}0") for c in "uv"), *(F.least(most(k) - 1, F.col(f"{c}1") + MARGIN).cast("int").alias(f"{c}1") for k, c in enumerate("uv")))
    kind = mask.schema
    out = T.StructType([T.StructField("series", kind["series"].dataType), T.StructField("label", kind["label"].dataType), T.StructField("grp", T.IntegerType()), T.StructField("keys", T.ArrayType(kind["x"].dataType)), *(T.StructField(c, T.IntegerType()) for c in ("u0", "u1", "v0", "v1"))])
    parts = boxes.drop("axis").groupBy("series").applyInPandas(_groups, out)
    groups = parts.groupBy("series", "grp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("all_keys"), F.sort_array(F.collect_list("label")).alias("labels"), *(f(c).alias(f"g{c}") for c, f in (("u0", F.min), ("u1", F.max), ("v0", F.min), ("v1", F.max))))
    gap = F.exists(F.sequence(F.lit(1), F.size("all_keys") - 1), lambda i: F.get("all_keys", i) - F.get("all_keys", i - 1) > 1)
    groups = groups.filter(F.size("all_keys") > 1).filter(gap).join(F.broadcast(chosen), "series")
    return _filled(mask, pixels, parts, groups, step)


def _filled(mask: DataFrame, pixels: DataFrame, parts: DataFrame, groups: DataFrame, step: dict[str, float]) -> DataFrame:
    kind = mask.schema
    series, label, place = (kind[c].dataType for c in ("series", "label", "x"))
    # a row per pixel of a group's painted slice; maps: (layer, distances), layer 0 the union, then a label's own
    slices = pixels.drop("axis").join(parts.select("series", "label", "grp"), ["series", "label"]).join(groups, ["series", "grp"])
    maps = T.StructType([T.StructField("series", series), T.StructField("grp", T.IntegerType()), T.StructField("s", place), T.StructField("layer", label), T.StructField("d", T.BinaryType())])

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        grid = np.zeros((first["gu1"] - first["gu0"] + 1, first["gv1"] - first["gv0"] + 1), np.int64)
        grid[rows["u"] - first["gu0"], rows["v"] - first["gv0"]] = rows["label"]
        steps = tuple(step[c] for c in ACROSS[first["axis"]])
        layers = [(0, grid > 0)] + [(x, grid == x) for x in sorted(set(rows["label"]))] * (len(first["labels"]) > 1)
        return pd.DataFrame([(first["series"], first["grp"], first["s"], x, signed_distances(on, steps).tobytes()) for x, on in layers], columns=maps.names)

    measured = slices.groupBy("series", "grp", "s").applyInPandas(measure, maps)
    # every layer on every painted slice of its group: a label's own nearest slice, pushed out by the way to it
    layers = groups.select("series", "grp", "axis", "all_keys", "labels", F.explode(F.when(F.size("labels") > 1, F.concat(F.array(F.lit(0).cast(label)), "labels")).otherwise(F.array(F.lit(0).cast(label)))).alias("layer"))
    own = parts.select("series", F.col("label").alias("layer"), F.col("keys").alias("own_keys"))
    layers = layers.join(own, ["series", "layer"], "left").withColumn("own_keys", F.coalesce("own_keys", "all_keys")).withColumn("key", F.explode("all_keys"))
    nearest = F.array_min(F.transform("own_keys", lambda k: F.struct(F.abs(k - F.col("key")).alias("far"), k.alias("k"))))
    layers = layers.select("series", "grp", "axis", "layer", "key", nearest["k"].alias("s"), nearest["far"].alias("far"))
    known = layers.join(measured, ["series", "grp", "layer", "s"])
    turn = Window.partitionBy("series", "grp", "layer").orderBy("key")  # as many rows as painted slices
    whole = F.struct("key", "far", "d")
    ahead = known.select("series", "grp", "axis", "layer", whole.alias("d0"), F.lag(whole).over(turn).alias("pa"), F.lead(whole, 1).over(turn).alias("d1"), F.lead(whole, 2).over(turn).alias("pb"))
    gaps = ahead.filter(F.col("d1.key") - F.col("d0.key") > 1).withColumn("pa", F.coalesce("pa", "d0")).withColumn("pb", F.coalesce("pb", "d1"))
    stacked = gaps.groupBy("series", "grp", "axis", F.col("d0.key").alias("k0")).agg(F.sort_array(F.collect_list(F.struct("layer", "pa", "d0", "d1", "pb"))).alias("layers"))
    stacked = stacked.join(groups.select("series", "grp", "labels", "gu0", "gv0", "gv1"), ["series", "grp"]).withColumn("s", F.explode(F.sequence(F.col("k0") + 1, F.col("layers")[0]["d1"]["key"] - 1)))
    found = T.StructType([T.StructField("series", series), T.StructField("axis", T.StringType()), T.StructField("s", place), T.StructField("u", place), T.StructField("v", place), T.StructField("deep", T.DoubleType()), T.StructField("label", label)])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, made = [], row["layers"]
                for x in made:
                    push = step[row["axis"]]
                    p = [np.frombuffer(x[c]["d"]) + push * x[c]["far"] for c in ("pa", "d0", "d1", "pb")]
                    ka, k0, k1, kb = (x[c]["key"] for c in ("pa", "d0", "d1", "pb"))
                    t, gap = (row["s"] - k0) / (k1 - k0), k1 - k0
                    at.append(p[1] * (2 * t**3 - 3 * t**2 + 1) + (p[2] - p[0]) * (t**3 - 2 * t**2 + t) * (gap / (k1 - ka)) + p[2] * (3 * t**2 - 2 * t**3) + (p[3] - p[1]) * (t**3 - t**2) * (gap / (kb - k0)))
                    if not x["layer"]:  # it may bulge between slices, but opens no hole where both are inside
                        deep = np.minimum(at[0], np.maximum(p[1], p[2]))
                inside = np.flatnonzero(deep < 0)
                labels = np.array([x["layer"] for x in made[1:]])[np.argmin(np.stack(at[1:])[:, inside], axis=0)] if len(made) > 1 else np.full(len(inside), row["labels"][0])
                v, n = row["gv1"] - row["gv0"] + 1, len(inside)
                columns = [[row["series"]] * n, [row["axis"]] * n, [row["s"]] * n, row["gu0"] + inside // v, row["gv0"] + inside % v, deep[inside], labels]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow(found), strict=True)], schema=to_arrow(found))

    rows = stacked.mapInArrow(between, found)
    best = rows.groupBy("series", "axis", "s", "u", "v").agg(F.min_by("label", F.struct("deep", "label")).alias("label"))
    coordinate = lambda c: F.coalesce(*(F.when(F.col("axis") == a, F.col("s" if a == c else "uv"[ACROSS[a].index(c)])) for a in AXES))
    new = best.select("series", *(coordinate(c).alias(c) for c in AXES), "label")
    return new.join(mask, ["series", *AXES], "left_anti")


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)

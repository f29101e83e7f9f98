"""Where a voxel grid lies in the patient: geometry from an affine, the nearest axis order, voxels laid out anew and back.

Axes of a canonical grid point to the patient's left, back and head.  Headers (a row per volume) are worked on one by one in
Arrow batches; a volume's voxels then move by plain expressions, without a shuffle once the header is joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNS = np.array([-1.0, -1.0, 1.0])
NUMBERS, TURNS = T.ArrayType(T.DoubleType()), T.ArrayType(T.BooleanType())
ORIENTED = T.StructType([T.StructField("origin", NUMBERS), T.StructField("spacing", NUMBERS), T.StructField("direction", T.ArrayType(NUMBERS)), T.StructField("perm", T.ArrayType(T.IntegerType())), T.StructField("flip", TURNS)])


def geometry_of(affine: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(origin, spacing, direction: a unit vector for each voxel axis) of an affine from voxels to right, front, head in mm.

    The first two axes change their signs.  None if a column has no length."""
    a = np.array([row[:4] for row in affine[:3]], float) * SIGNS[:, None]
    spacing = np.linalg.norm(a[:, :3], axis=0)
    if not (np.isfinite(spacing).all() and (spacing > 1e-9).all()):
        return None
    return a[:, 3], spacing, (a[:, :3] / spacing).T


def affine_of(origin: np.ndarray, spacing: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The affine (four rows) of a geometry."""
    top = np.column_stack([np.asarray(direction).T * spacing, origin]) * SIGNS[:, None]
    return np.vstack([top, [0, 0, 0, 1]])


def axis_order(direction: np.ndarray) -> tuple[list[int], list[bool]]:
    """(perm, flip): canonical axis t is voxel axis perm[t], backwards where flip[t].

    The largest cosine decides first, then the largest of what is left, so that an oblique grid too gets a true permutation; of
    equal ones the first voxel axis, then the first patient axis."""
    size = np.abs(np.asarray(direction, float))
    perm, flip = [0, 1, 2], [False] * 3
    for _ in range(3):
        s, t = np.unravel_index(np.argmax(size), (3, 3))
        perm[t], flip[t] = int(s), bool(direction[s][t] < 0)
        size[s], size[:, t] = -1, -1
    return perm, flip


def reordered(origin: np.ndarray, spacing: np.ndarray, direction: np.ndarray, dims: tuple[int, int, int], perm: list[int], flip: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same patient space for the canonical grid: where an axis is turned, the origin moves to its other end."""
    origin = np.array(origin, float)
    for s, turned in zip(perm, flip, strict=True):
        if turned:
            origin += direction[s] * (dims[s] - 1) * spacing[s]
    return origin, np.asarray(spacing)[perm], np.asarray(direction)[perm] * np.where(flip, -1, 1)[:, None]


def oriented(headers: DataFrame, affine: str = "affine") -> DataFrame:
    """headers with orientation: struct(origin, spacing, direction, perm, flip) of their affine, null where it has none."""
    kind = T.StructType([*headers.schema, T.StructField("orientation", ORIENTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            made = []
            for value in batch.column(affine).to_pylist():
                found = geometry_of(value) if value else None
                order = axis_order(found[2]) if found else None
                made.append(found and {"origin": found[0].tolist(), "spacing": found[1].tolist(), "direction": found[2].tolist(), "perm": order[0], "flip": order[1]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, to_arrow_type(ORIENTED))], names=[*batch.schema.names, "orientation"])

    return headers.mapInArrow(run, kind)


def to_canonical(x: Column, y: Column, z: Column, dims: Column, order: Column) -> tuple[Column, Column, Column]:
    """A voxel's place in the canonical grid; dims are those of its own grid, order is an orientation."""
    place = F.array(x, y, z)

    def axis(t: int) -> Column:
        s = F.get(order["perm"], t)
        return F.when(F.get(order["flip"], t), F.get(dims, s) - 1 - F.get(place, s)).otherwise(F.get(place, s))

    return axis(0), axis(1), axis(2)


def from_canonical(x: Column, y: Column, z: Column, dims: Column, order: Column) -> tuple[Column, Column, Column]:
    """The way back: dims are still those of the voxel's own grid."""
    place = F.array(x, y, z)

    def axis(s: int) -> Column:
        t = (F.array_position(order["perm"], F.lit(s)) - 1).cast("int")
        return F.when(F.get(order["flip"], t), F.get(dims, F.lit(s)) - 1 - F.get(place, t)).otherwise(F.get(place, t))

    return axis(0), axis(1), axis(2)

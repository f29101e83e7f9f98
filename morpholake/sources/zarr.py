"""OME-Zarr version 2 as a data source: a chunk is an input partition, and filters on its indices prune chunks unread."""

from __future__ import annotations

import gzip
import itertools
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

AXES = ("t", "c", "z")
SCHEMA = T.StructType([T.StructField(c, T.IntegerType(), False) for c in ("level", *AXES, "chunk_y", "chunk_x", "y0", "x0", "height", "width")] + [T.StructField("data", T.ArrayType(T.DoubleType(), False), False)])
CHUNKS_PER_TASK = 16


def parse_array(text: bytes) -> dict:
    """The .zarray metadata, checked: version 2, C order, five axes, a known codec and type."""
    meta = json.loads(text)
    if meta.get("zarr_format") != 2:
        raise ValueError(f"zarr-format: {meta.get('zarr_format')}")
    if meta.get("order", "C") != "C" or len(meta["shape"]) != 5 or len(meta["chunks"]) != 5:
        raise ValueError("zarr-layout: want C order and the axes t, c, z, y, x")
    if meta["dtype"][1:] not in ("u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"):
        raise ValueError(f"zarr-dtype: {meta['dtype']}")
    if (codec := (meta.get("compressor") or {}).get("id")) not in (None, "gzip", "zlib"):
        raise ValueError(f"zarr-codec: {codec}")
    return meta


def plate_wells(documents: DataFrame, attrs: str = "attrs") -> DataFrame:
    """plate, path, row, column and label (row's and column's names joined) of the wells of plates' attributes (JSON).

    What has no plate gives nothing; a well without a path or outside the plate's rows and columns raises."""
    named = "array<struct<name:string>>"
    well = "array<struct<path:string,rowIndex:int,columnIndex:int>>"
    plate = F.get_json_object(attrs, "$.plate")
    part = lambda key, kind: F.from_json(F.get_json_object(plate, f"$.{key}"), kind)
    rows = documents.filter(plate.isNotNull()).select(F.get_json_object(plate, "$.name").alias("plate"), part("rows", named).alias("r"), part("columns", named).alias("c"), F.explode(part("wells", well)).alias("w"))
    inside = F.col("w.path").isNotNull() & F.col("w.rowIndex").between(0, F.size("r") - 1) & F.col("w.columnIndex").between(0, F.size("c") - 1)
    path = F.when(F.coalesce(inside, F.lit(False)), F.col("w.path")).otherwise(F.raise_error(F.concat(F.lit("plate-well: "), F.coalesce("w.path", F.lit("no path")))).cast("string"))
    return rows.select("plate", path.alias("path"), F.col("w.rowIndex").alias("row"), F.col("w.columnIndex").alias("column"), F.concat(F.get("r", F.col("w.rowIndex"))["name"], F.get("c", F.col("w.columnIndex"))["name"]).alias("label"))


def well_images(documents: DataFrame, attrs: str = "attrs") -> DataFrame:
    """image_no, path of the images of wells' attributes (JSON); a well without an image, or an image without a path, raises."""
    images = F.get_json_object(attrs, "$.well.images")
    rows = documents.filter(F.get_json_object(attrs, "$.well").isNotNull()).select(F.from_json(images, "array<struct<path:string>>").alias("i"))
    some = F.when(F.size("i") > 0, F.col("i")).otherwise(F.raise_error(F.lit("well-images: none")).cast("array<struct<path:string>>"))
    placed = rows.select(F.posexplode(some).alias("image_no", "image"))
    return placed.select("image_no", F.when(F.col("image.path") != "", F.col("image.path")).otherwise(F.raise_error(F.lit("well-images: path")).cast("string")).alias("path"))


def decode_chunk(raw: bytes, meta: dict) -> np.ndarray:
    codec = (meta.get("compressor") or {}).get("id")
    data = gzip.decompress(raw) if codec == "gzip" else zlib.decompress(raw) if codec == "zlib" else raw
    return np.frombuffer(data, np.dtype(meta["dtype"])).reshape(meta["chunks"]).astype(np.float64)


@dataclass
class Chunks(InputPartition):
    items: list[tuple[str, int, tuple[int, ...]]]
    metas: dict[str, dict] = field(default_factory=dict)


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of one index column with a number are decided for a whole chunk row; the rest go back to Spark."""
        for f in filters:
            kind = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In)
            if kind and len(f.attribute) == 1 and f.attribute[0] in ("level", "t", "c", "z", "chunk_y", "chunk_x"):
                self.tests.append(f)
            else:
                yield f

    def holds(self, row: dict[str, int]) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            ok = v in f.value if isinstance(f, In) else v == f.value if isinstance(f, EqualTo) else v > f.value if isinstance(f, GreaterThan) else v >= f.value if isinstance(f, GreaterThanOrEqual) else v < f.value if isinstance(f, LessThan) else v <= f.value
            if not ok:
                return False
        return True

    def _planes(self, meta: dict, level: int, index: tuple[int, ...]) -> list[dict[str, int]]:
        """The planes (t, c, z) of a chunk inside the array that pass the filters."""
        shape, size = meta["shape"], meta["chunks"]
        ranges = [range(index[a] * size[a], min(shape[a], (index[a] + 1) * size[a])) for a in range(3)]
        rows = ({"level": level, "t": t, "c": c, "z": z, "chunk_y": index[3], "chunk_x": index[4]} for t, c, z in itertools.product(*ranges))
        return [r for r in rows if self.holds(r)]

    def partitions(self) -> list[Chunks]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

        def text(name: str) -> bytes:
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                return f.read()

        scales = json.loads(text(".zattrs"))["multiscales"][0]["datasets"]
        items, metas = [], {}
        for level, scale in enumerate(scales):
            meta = metas[scale["path"]] = parse_array(text(f"{scale['path']}/.zarray"))
            counts = [math.ceil(n / c) for n, c in zip(meta["shape"], meta["chunks"], strict=True)]
            items += [(scale["path"], level, i) for i in itertools.product(*map(range, counts)) if self._planes(meta, level, i)]
        return [Chunks(items[k : k + CHUNKS_PER_TASK], metas) for k in range(0, len(items), CHUNKS_PER_TASK)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for path, level, index in partition.items:
            meta = partition.metas[path]
            name = f"{root}/{path}/{meta.get('dimension_separator', '.').join(map(str, index))}"
            size, shape = meta["chunks"], meta["shape"]
            if store.get_file_info(name).type == fs.FileType.NotFound:
                chunk = np.full(size, float(meta.get("fill_value") or 0))
            else:
                with store.open_input_stream(name, compression=None) as f:
                    chunk = decode_chunk(f.read(), meta)
            y0, x0 = index[3] * size[3], index[4] * size[4]
            h, w = min(size[3], shape[3] - y0), min(size[4], shape[4] - x0)
            for r in self._planes(meta, level, index):
                tile = chunk[r["t"] - index[0] * size[0], r["c"] - index[1] * size[1], r["z"] - index[2] * size[2], :h, :w]
                ints = [r["level"], r["t"], r["c"], r["z"], index[3], index[4], y0, x0, h, w]
                flat = pa.ListArray.from_arrays(pa.array([0, h * w], pa.int32()), pa.array(np.ascontiguousarray(tile).ravel()))
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in ints), flat], names=SCHEMA.names)


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "omezarr"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ZarrReader:
        return ZarrReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("omezarr") known and lets filters reach Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrSource)

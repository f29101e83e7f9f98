"""Helpers that several operators share: tables, shared storage, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts state it: space and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def map_batches(source: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """source.mapInArrow(run, schema) for columns of any name (it takes none with a dot), memory handed back at the end."""
    names = source.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return source.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(handing_back(named), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset (tests on one machine) a temporary folder is made once and kept in the session's settings."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='morpholake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors.

    The written schema is handed to the reader, so no extra job infers it and empty tables work."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, what))
    out = spark.read.schema(df.schema).parquet(path)
    out._morpholake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, through Hadoop's file system so that any store works."""
    spark, path = df.sparkSession, getattr(df, "_morpholake_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered 1, 2, ... in this order: a range sort, written; each partition only tells how many rows it has."""
    at = free_name("_at", df.columns)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for k, n in sorted(laid.groupBy(part.alias("k")).count().collect()):  # a row per partition
        starts.append((k, before))
        before += n
    kept = free_name("_start", df.columns)
    found = df.sparkSession.createDataFrame(starts, f"_part long, {kept} long")
    return laid.join(F.broadcast(found), part == found["_part"]).select(*map(column, df.columns), (F.col(kept) + place + 1).alias(name))


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores before it until no taken name equals it (Spark's names do not heed case)."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id belongs to no held-out fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(-1))


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; when its task ends, the worker hands free memory back to the system.

    Spark keeps a worker for the next task, maybe of another stage, and else what one stage took adds to the next one's."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
                trim(0)

    return ran


def hashed_sample(rows: DataFrame, most: int, key: list[str]) -> DataFrame:
    """About `most` rows, chosen by a hash of key columns: all rows of a table of at most that many.

    A filter, not a sort: each task keeps its share, and what is kept does not grow with the table."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (views, not copies), so that Python objects of few texts live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_of(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

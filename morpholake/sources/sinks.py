"""Reports as files: CSV and JSON by Spark's writers, NIfTI by one row per volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def measurement_lines(rows: DataFrame) -> DataFrame:
    """One CSV line per measurement, numbers to three digits, text quoted where it must be."""
    text = lambda c: F.when(F.col(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    number = F.coalesce(half_up(F.col("value"), 3).cast("string"), F.lit(""))
    return rows.select(F.concat_ws(",", text("label"), text("kind"), number, text("unit")).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def report_json(rows: DataFrame, by: str) -> DataFrame:
    """by and a JSON document of the group's rows, in the order of row_no."""
    others = [c for c in rows.columns if c != by]
    packed = F.array_sort(F.collect_list(F.struct("row_no", *(c for c in others if c != "row_no"))))
    return rows.groupBy(by).agg(F.to_json(packed).alias("json"))


MEASUREMENTS = "row_no bigint, kind string, label string, value double"


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurements written as JSON lines; a line that is no such record, or a value that is not finite, raises bad-measurement."""
    rows = spark.read.schema(f"{MEASUREMENTS}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    bad = F.col("broken").isNotNull() | F.col("kind").isNull() | F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    kind = F.when(~bad, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("bad-measurement: "), F.coalesce("broken", F.to_json(F.struct("row_no", "kind", "label"))))).cast("string"))
    return rows.select("row_no", kind.alias("kind"), "label", "value")

"""Running values of groups of any size: rows are range-sorted by group and order, so a large group spreads over partitions.

A partition works on its own stretch of a group; what it passes on (a sum, a last value) is one row per group and partition,
carried over by a window over those rows, and joined back.  The sorted rows are written once, as both sides read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

PART = "_part"


def laid(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows, range-sorted by group and order, with the number of their partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *by, *order).withColumn(PART, F.spark_partition_id()))


def within(by: list[str], order: list[Column | str]) -> Window:
    """A partition's own stretch of a group, in order."""
    return Window.partitionBy(*by, PART).orderBy(*order)


def carried(rows: DataFrame, by: list[str], *values: tuple[str, Column]) -> DataFrame:
    """rows (of laid) with a column per value: what an aggregate of each earlier stretch of the group passes on.

    A value is (name, aggregate of a stretch); the name's kind tells how stretches add up: sum_..., last_... (the last that is not
    null) or min_, max_."""
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    ends = rows.groupBy(*by, PART).agg(*(f.alias(f"_{name}") for name, f in values))
    how = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "last": lambda c: F.last(c, True).over(before), "max": lambda c: F.max(c).over(before), "next": lambda c: F.first(c, True).over(after)}
    keys = {b: f"_on_{k}" for k, b in enumerate([*by, PART])}
    passed = ends.select(*(F.col(b).alias(k) for b, k in keys.items()), *(how[name.split("_")[0]](f"_{name}").alias(name) for name, _ in values))
    on = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(k)) for b, k in keys.items()))
    return rows.join(passed, on).drop(*keys.values())


def running_sum(rows: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to and with each row."""
    on = carried(laid(rows, by, order), by, ("sum_before", F.sum(value)))
    return on.withColumn(name, F.col("sum_before") + F.sum(value).over(within(by, order))).drop(PART, "sum_before")


def ranked_counts(values: DataFrame, by: list[str], v: str) -> DataFrame:
    """by, x, c, upto, total: each value with its count, the count of those up to it, and of all; from counts per value."""
    counts = values.filter(F.col(v).isNotNull()).groupBy(*by, F.col(v).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    summed = running_sum(counts, by, ["x"], F.col("c"), "upto")
    return summed.join(summed.groupBy(*by).agg(F.max("upto").alias("total")), by)


def percentile(values: DataFrame, by: list[str], v: str, **shares: float) -> DataFrame:
    """by and a column for each name: the exact percentile, interpolated between the two values around it."""
    ranked = ranked_counts(values, by, v)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("x")))

    low, out = {}, []
    for name, p in shares.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        low[name] = at(F.floor(place)).alias(f"_l_{name}"), at(F.ceil(place)).alias(f"_h_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")
        out.append((F.col(f"_l_{name}") + F.col(f"_f_{name}") * (F.col(f"_h_{name}") - F.col(f"_l_{name}"))).alias(name))
    return ranked.groupBy(*by).agg(*(c for three in low.values() for c in three)).select(*by, *out)

"""Set operations that keep order, duplicates or priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_union(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    return a.select(*columns).unionByName(b.select(*columns)).distinct().orderBy(*columns)


def intersect_keeping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a, duplicates included, whose key is in b."""
    return a.join(b, on, "left_semi")


def expand(low: Column, high: Column) -> Column:
    """All integers between two ends, inclusive, in either order of the ends."""
    return F.sequence(F.least(low, high), F.greatest(low, high))


def merge_keeping_first(lists: list[DataFrame], identity: list[str], order: str) -> DataFrame:
    """One row per identity over all lists: of the earliest list, then the least order."""
    tagged = [rows.withColumn("_list", F.lit(k)) for k, rows in enumerate(lists)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    others = [c for c in union.columns if c not in (*identity, "_list")]
    return union.groupBy(*identity).agg(F.min_by(F.struct("_list", *others), F.struct("_list", order)).alias("m")).select(*identity, F.col("m._list").alias("list_no"), *(F.col(f"m.{c}").alias(c) for c in others))


def overlay(masks: DataFrame, position: list[str], value: str = "label") -> DataFrame:
    """The lowest label at each position; labels outside 1 to 255 raise."""
    checked = F.when(F.col(value).between(1, 255), F.col(value)).otherwise(F.raise_error(F.format_string("label out of range: %s", F.col(value).cast("string"))).cast("int"))
    return masks.select(*position, checked.alias("_v")).groupBy(*position).agg(F.min("_v").alias(value))


def replace_label(labels: DataFrame, old: int, new: int, value: str = "label") -> DataFrame:
    return labels.withColumn(value, F.when(F.col(value) == old, new).otherwise(F.col(value)))


def newly_added(grown: DataFrame, before: DataFrame, position: list[str]) -> DataFrame:
    return grown.join(before, position, "left_anti")

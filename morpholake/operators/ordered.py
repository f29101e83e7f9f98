"""Ordered analytics: drift, runs, gaps, arc length, event logs, states, top rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_up
from .graph import cut
from .running import PART, carried, laid, running_sum, within


def phantom_trend(points: DataFrame, by: list[str]) -> DataFrame:
    """pass (within tolerance) and drift against the earliest point (date, row_no) of the group."""
    first = points.groupBy(*by).agg(F.min_by("mean_hu", F.struct("date", "row_no")).alias("_base"))
    near = F.abs(F.col("mean_hu") - F.col("expected_hu")) <= F.col("tolerance_hu")
    return points.join(first, by).withColumn("pass", near).withColumn("drift_hu", half_up(F.col("mean_hu") - F.col("_base"), 3)).drop("_base")


def integer_ranges(ids: DataFrame, by: list[str], i: str = "i") -> DataFrame:
    """Runs of consecutive integers as inclusive ranges; repeated ids count once."""
    order = Window.partitionBy(*by).orderBy(i)
    islands = ids.select(*by, i).distinct().withColumn("_g", F.col(i) - F.row_number().over(order))
    return islands.groupBy(*by, "_g").agg(F.min(i).alias("low"), F.max(i).alias("high")).drop("_g")


def stack_gaps(slices: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """Per stack: slices, least and largest gap between neighbours, and their upper median."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    gaps = slices.withColumn("gap", gap)
    ranked = gaps.filter("gap is not null").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("gap"))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    median = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("gap")))
    return ranked.groupBy(*by).agg((F.max("_n") + 1).alias("slices"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), median.alias("median_gap"))


def anchored_clusters(rows: DataFrame, by: list[str], at: str, tolerance: float) -> DataFrame:
    """cluster (0-based) and phase (place in the cluster): a row opens a cluster when it lies at least tolerance past the
    cluster's first row.

    A row that lies so far past the one before it opens a cluster whatever came before; these cut a group into runs.  Within a
    run the comparison is with the cluster's first member: each run is one stretch of a sorted stream that a task folds row by
    row, holding nothing but the last cluster.  Runs then take their first cluster's number from running sums."""
    order = [at, "row_no"]
    spread = laid(rows.select(*by, "row_no", F.col(at).cast("double").alias(at)), by, order)
    told = carried(spread, by, ("max_at", F.max(at)))
    before = F.coalesce(F.lag(at).over(within(by, order)), F.col("max_at"))
    told = told.withColumn("_opens", F.coalesce(F.col(at) - before >= tolerance, F.lit(True)).cast("int"))
    runs = running_sum(told.drop(PART, "max_at"), by, order, F.col("_opens"), "_run")
    keys = [*by, "_run"]
    kinds = T.StructType([*(runs.schema[k] for k in keys), T.StructField("row_no", T.LongType()), T.StructField("_k", T.IntegerType()), T.StructField("phase", T.IntegerType())])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = runs.select(*keys, F.col("row_no").cast("bigint").alias("row_no"), F.col(at).alias("_at")).repartition(parts, *keys).sortWithinPartitions(*keys, "_at", "row_no")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, anchor, k, phase = None, 0.0, 0, 0
        for batch in batches:
            found = []
            for *key, place in zip(*(batch.column(c).to_pylist() for c in [*keys, "_at"]), strict=True):
                if key != run:
                    run, anchor, k, phase = key, place, 0, 0
                elif place - anchor >= tolerance:
                    anchor, k, phase = place, k + 1, 0
                else:
                    phase += 1
                found.append((k, phase))
            made = [pa.array([f[i] for f in found], pa.int32()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, "row_no"]), *made], names=[*keys, "row_no", "_k", "phase"])

    folded = cut(sorted_runs.mapInArrow(fold, kinds))
    sizes = running_sum(folded.groupBy(*keys).agg((F.max("_k") + 1).alias("_n")), by, ["_run"], F.col("_n"), "_upto")
    first = sizes.select(*keys, (F.col("_upto") - F.col("_n")).alias("_first"))
    return folded.join(first, keys).select(*by, "row_no", (F.col("_first") + F.col("_k")).cast("int").alias("cluster"), "phase")


def arc_length(points: DataFrame, by: list[str], order: str, axes: tuple[str, ...] = ("x", "y", "z"), spacing: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """cumulative: length along the line up to each point."""
    spread = carried(laid(points, by, [order]), by, *((f"last_{a}", F.max_by(a, order)) for a in axes))
    w = within(by, [order])
    step2 = sum((F.pow((F.col(a) - F.coalesce(F.lag(a).over(w), F.col(f"last_{a}"))) * s, 2) for a, s in zip(axes, spacing, strict=True)), F.lit(0.0))
    stepped = spread.withColumn("_d", F.coalesce(F.sqrt(step2), F.lit(0.0))).drop(*(f"last_{a}" for a in axes), PART)
    return running_sum(stepped, by, [order], F.col("_d"), "cumulative").drop("_d")


def segment_starts(rows: DataFrame, by: list[str], position: str, starts: DataFrame, start: str) -> DataFrame:
    """As-of lookup: the last start at or before each row's position, from a sorted union instead of a pairwise join."""
    union = rows.withColumn("_s", F.lit(None).cast(starts.schema[start].dataType)).unionByName(starts.select(*by, F.col(start).alias(position), F.col(start).alias("_s")), allowMissingColumns=True)
    order = [F.col(position), F.col("_s").isNull().cast("int")]
    spread = carried(laid(union, by, order), by, ("max_s", F.max("_s")))
    return spread.withColumn("segment", F.coalesce(F.last("_s", True).over(within(by, order)), F.col("max_s"))).filter("_s is null").drop("_s", "max_s", PART)


#: Allowed moves of a reading state.
MOVES = {"unread": {"open": "reading"}, "reading": {"finish": "read"}, "read": {"sign": "signed", "open": "reading"}, "signed": {"unlock": "read"}}


def read_states(events: DataFrame, by: str, action: str, order: list[str]) -> DataFrame:
    """Last state of each series after its actions in order; an action that the state does not allow changes nothing.

    Each partition of the sorted events tells, for its stretch of a series, where it leads from every state; these maps are put
    one after another.  So a series may be as long as it likes."""
    spread = laid(events.select(by, *order, F.col(action).alias("_action")), [by], order)

    def moved(state: Column, done: Column) -> Column:
        out = state
        for s, moves in MOVES.items():
            for a, to in moves.items():
                out = F.when((state == s) & (done == a), to).otherwise(out)
        return out

    sorted_ = F.array_sort(F.collect_list(F.struct(*order, "_action")))
    each = spread.groupBy(by, PART).agg(sorted_.alias("_e"))
    ends = each.select(by, PART, F.size("_e").alias("_n"), *(F.aggregate("_e", F.lit(s), lambda state, e: moved(state, e["_action"])).alias(f"from_{s}") for s in MOVES))
    follow = lambda state, m: F.coalesce(*(F.when(state == s, m[f"from_{s}"]) for s in MOVES))
    whole = ends.groupBy(by).agg(F.sum("_n").alias("n_events"), F.array_sort(F.collect_list(F.struct(PART, *(f"from_{s}" for s in MOVES)))).alias("_m"))
    return whole.select(by, "n_events", F.aggregate("_m", F.lit("unread"), follow).alias("state"))


def newest(events: DataFrame, by: list[str], order: list[str], keep: int) -> DataFrame:
    """The newest rows of each group: a ring of so many."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def sibling_numbers(groups: DataFrame, by: list[str], size: str, tie: str) -> DataFrame:
    return groups.withColumn("sibling", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(size), tie)))


def pyramid_level(levels: DataFrame, by: list[str], target: float) -> DataFrame:
    """The last level that is at least so wide, else 0."""
    return levels.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("width") >= target, F.col("level"))), F.lit(0)).alias("level"))


def limit_with_rest(rows: DataFrame, n: int, *order: str) -> tuple[DataFrame, int]:
    """The first n rows and how many more there are."""
    return rows.orderBy(*order).limit(n), max(0, rows.count() - n)


def nearest_plane(planes: DataFrame, by: list[str], want: dict[str, int]) -> DataFrame:
    """The plane nearest to the wanted indices by summed distance, the first by index on ties."""
    distance = sum((F.abs(F.col(a) - v) for a, v in want.items()), F.lit(0))
    return planes.groupBy(*by).agg(F.min(F.struct(distance.alias("distance"), *want)).alias("m")).select(*by, *(F.col(f"m.{a}").alias(a) for a in want), F.col("m.distance").alias("distance"))


def unordered_steps(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is less than the one before: none where a curriculum never gets easier."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).filter(F.col(value) < F.col("before"))


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation that depends on key and seed alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key)


def work_queue(requests: DataFrame, key: str, tier: str, arrival: str) -> DataFrame:
    """One row per key, its best tier and, within that, its first arrival; in the order of the queue."""
    return requests.groupBy(key).agg(F.min(F.struct(tier, arrival)).alias("m")).select(key, f"m.{tier}", f"m.{arrival}").orderBy(tier, arrival)

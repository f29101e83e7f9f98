"""Live views over event streams: windowed facets with late data, reading states, a mailbox of the latest link."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import MOVES


def live_facets(events: DataFrame, ts: str, by: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window_start, by, n: counts per window; events later than `late` are left out and closed windows leave the state."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """by, start, end, n: events of one key with no gap so long between them."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drop_repeats(events: DataFrame, ts: str, keys: list[str], late: str = "30 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def live_states(events: DataFrame, by: str, action: str, order: str) -> DataFrame:
    """Each series' reading state after every batch that touched it: the state machine of the batch operator, kept per key.

    Within a batch a series' events apply in order; state is one short string per series."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seen = state.get if state.exists else ("unread", 0)
        rows = pd.concat(list(parts))
        for a in rows.sort_values(order)[action]:
            at = MOVES.get(at, {}).get(a, at)
        state.update((at, seen := int(seen) + len(rows)))
        yield pd.DataFrame({by: [key[0]], "n_events": [seen], "state": [at]})

    kind = events.schema[by].dataType.simpleString()
    return events.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n_events long, state string", "state string, n long", "update", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The newest value of each key."""
    return events.groupBy(by).agg(F.max_by(value, order).alias(value))

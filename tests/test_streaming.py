from datetime import datetime, timedelta

import pytest

from morpholake.operators.ordered import read_states
from morpholake.streaming import live


@pytest.fixture()
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "ts", "user_id as series", "case event_type when 'view' then 'open' when 'click' then 'finish' when 'purchase' then 'sign' when 'error' then 'unlock' else 'other' end as action")


def stream_of(spark, events, path, files):
    ordered = events.orderBy("ts", "event_id").collect()
    size = -(-len(ordered) // files)
    for k in range(files):
        spark.createDataFrame(ordered[k * size : (k + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def run(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()


def test_states_equal_the_batch_fold(spark, events, tmp_path):
    some = events.filter("series < 12")
    run(live.live_states(stream_of(spark, some, str(tmp_path / "in"), 3), "series", "action", "event_id"), "states", "update", tmp_path)
    last = {}
    for r in spark.table("states").collect():
        if r.n_events >= last.get(r.series, (0, ""))[0]:
            last[r.series] = (r.n_events, r.state)
    want = {r.series: (r.n_events, r.state) for r in read_states(some, "series", "action", ["ts", "event_id"]).collect()}
    assert last == want


def test_late_events_are_left_out(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda *minutes: [(t + timedelta(minutes=m), "a") for m in minutes]
    path = str(tmp_path / "in")
    for part in (at(1, 2), at(120), at(125), at(3), at(300)):
        spark.createDataFrame(part, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(path)
    run(live.live_facets(stream, "ts", "kind"), "facets", "append", tmp_path)
    assert [(r.window_start, r.n) for r in spark.table("facets").orderBy("window_start").collect()][0] == (t, 2)


def test_batch_forms(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", t, 1), ("k", t + timedelta(minutes=5), 2), ("k", t + timedelta(hours=2), 3)], "key string, ts timestamp, v int")
    assert sorted(r.n for r in live.sessions(rows, "ts", "key").collect()) == [1, 2]
    assert live.latest(rows, "key", "ts", "v").first().v == 3

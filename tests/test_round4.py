"""Findings of round 4: the stream parses a row once, keeps its state on disk, and its sink and views don't sort every window."""

import json
import os

from pyspark.sql import functions as F

from chronoframe.operators import online
from chronoframe.operators.windows import current_windows, newest_features, stats_to_features
from chronoframe.session import scratch_path
from chronoframe.streaming.job import STATE_STORE, decode_events, run_stream

from helpers import ts

STATS = ("entity_id string, event_type string, window_start timestamp_ntz, window_end timestamp_ntz, avg_5min double, "
         "max_5min double, n_events long, batch_id long")


def _stats(spark):
    at = [(ts(f"2024-01-01 12:0{i}:00"), ts(f"2024-01-01 12:0{i + 5}:00")) for i in range(4)]
    return spark.createDataFrame(
        [("a", "purchase", *at[0], 1.0, 2.0, 1, 0), ("a", "purchase", *at[2], 5.0, None, 1, 0), ("a", "purchase", *at[3], None, None, 0, 0),
         ("a", "view", *at[1], 0.0, float("nan"), 1, 0), ("b", "view", *at[1], None, None, 0, 0), ("b", "view", *at[0], -1.0, -1.0, 2, 0)], STATS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_window_per_statistic(spark):
    """of each statistic the newest window that has a value, without a sort of all windows."""
    stats = _stats(spark)
    got = {(r.entity_id, r.feature_name): (str(r.value_num), r.event_ts) for r in newest_features(stats).collect()}
    best = {}
    for r in stats_to_features(stats).collect():
        k = (r.entity_id, r.feature_name)
        best[k] = max(best.get(k, (r.event_ts, "")), (r.event_ts, str(r.value_num)))
    assert got == {k: (v, t) for k, (t, v) in best.items()} and len(got) == 6
    assert got["a", "avg_5min_purchase_value"] == ("5.0", ts("2024-01-01 12:07:00")) and got["a", "max_5min_purchase"][0] == "2.0"
    plan = _plan(online.stream_updates(stats, 0))
    assert "HashAggregate" in plan and "Sort" not in plan
    early = online.stream_updates(stats, 0, as_of="2024-01-01 12:05:00").collect()
    assert {(r.entity_id, r.feature_name, r.value_num) for r in early} == {
        ("a", "avg_5min_purchase_value", 1.0), ("a", "max_5min_purchase", 2.0), ("b", "avg_5min_view", -1.0), ("b", "max_5min_view", -1.0)}


def test_current_windows_by_hash(spark):
    """the row of the latest batch, nulls included, without a sort of the log."""
    at = (ts("2024-01-01 12:00:00"), ts("2024-01-01 12:05:00"))
    log = spark.createDataFrame([("a", "view", *at, 1.0, 1.0, 1, 0), ("a", "view", *at, 2.0, None, 2, 3), ("a", "view", *at, 9.0, 9.0, 9, 1),
                                 (None, "view", *at, None, None, 0, 2)], STATS)
    now = current_windows(log)
    assert now.columns == log.columns
    assert {tuple(r) for r in now.collect()} == {("a", "view", *at, 2.0, None, 2, 3), (None, "view", *at, None, None, 0, 2)}
    assert "HashAggregate" in _plan(now) and "Sort" not in _plan(now)


def test_rows_are_parsed_once(spark):
    """the filters on the columns don't parse the row again."""
    rows = [json.dumps({"entity_id": "e", "event_type": "x", "value": 1.5, "timestamp": "2024-01-01T12:00:00", "metadata": None}),
            json.dumps({"entity_id": "e", "timestamp": "2024-01-01T12:00:00"}), json.dumps({"entity_id": "e", "event_type": "x", "timestamp": "?"}),
            json.dumps({"entity_id": "e", "event_type": "x", "value": "a word", "timestamp": "2024-01-01T12:00:00"}),
            '{"entity_id": "cut', "[1]", "null", "", None]
    raw = spark.createDataFrame([(r,) for r in rows], "value string")
    events, bad = decode_events(raw)
    assert sorted(((r.entity_id, r.value) for r in events.collect()), key=str) == [("e", 1.5), ("e", None)]
    reasons = {r._raw: r.reason for r in bad.collect()}
    assert len(reasons) == 7 and [reasons[x] for x in rows[1:3]] == ["no_event_type", "bad_timestamp"]
    assert {reasons[x] for x in rows[4:]} == {"unparsed_or_no_entity"}
    path = scratch_path(spark, "raw")
    raw.where("value is not null").write.text(path)
    for df in decode_events(spark.read.text(path)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_state_on_disk(spark):
    """the windows of a batch are not held in the heap; the session's settings stay as they were."""
    def run(root):
        local = root[len("file:"):] if root.startswith("file:") else root
        os.makedirs(f"{local}/in")
        with open(f"{local}/in/a.json", "w") as f:
            f.write(json.dumps({"entity_id": "e", "event_type": "x", "value": 1.0, "timestamp": "2024-01-01T12:00:00"}) + "\n")
        q = run_stream(spark.readStream.text(f"{root}/in"), f"{root}/store", f"{root}/ckpt", trigger={"availableNow": True})
        q.awaitTermination()
        assert q.exception() is None
        return {f.rsplit(".", 1)[-1] for _, _, names in os.walk(f"{local}/ckpt/state") for f in names}

    before = dict(spark.conf.getAll)
    assert "zip" in run(scratch_path(spark, "state"))
    assert dict(spark.conf.getAll) == before
    provider = next(k for k in STATE_STORE if k.endswith("providerClass"))
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert "zip" not in run(scratch_path(spark, "state"))  # the session's own choice holds
    finally:
        spark.conf.unset(provider)

"""The stream's store: both sinks or neither, deltas, compaction, closed windows."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from chronoframe.session import scratch_path
from chronoframe.sources import files
from chronoframe.streaming.job import run_stream
from chronoframe.streaming.store import StoreSink, WindowStore


def _stats(spark, rows):
    """(entity, type, minute of the window's start, avg)"""
    return spark.createDataFrame(rows, "entity_id string, event_type string, m int, avg_5min double").select(
        "entity_id", "event_type", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m)").alias("window_start"),
        F.expr("timestamp_ntz'2024-01-01 00:05:00' + make_interval(0,0,0,0,0,m)").alias("window_end"),
        "avg_5min", F.col("avg_5min").alias("max_5min"), F.lit(1).cast("long").alias("n_events"))


def _values(df):
    return {(r.entity_id, r.feature_name): r.value_num for r in df.collect()}


def test_changed_keys_only_and_compaction(spark):
    store = WindowStore(spark, scratch_path(spark, "store"), compact_every=100)
    assert store.log() is None and store.snapshot() is None and store.windows() is None
    for i in range(4):
        assert store.write_batch(_stats(spark, [("e1", "view", i, float(i)), (f"only{i}", "view", i, 9.0)]), i, 3600)
    delta = spark.read.parquet(f"{store.root}/delta/batch={3:012d}")
    assert {r.entity_id for r in delta.collect()} == {"e1", "only3"}  # not the keys of the batches before
    before = _values(store.snapshot())
    assert before[("e1", "avg_5min_view")] == 3.0 and len(before) == 10
    store.compact()
    assert store.head()["deltas"] == [] and _values(store.snapshot()) == before
    store.write_batch(_stats(spark, [("e1", "view", 2, 5.0)]), 4, 3600)  # an older window doesn't replace a newer one
    assert _values(store.snapshot()) == before and len(store.head()["deltas"]) == 1
    assert store.windows().where("entity_id = 'e1' and n_events = 1").count() == 4
    assert store.windows(since="2024-01-02").count() == 0
    plan = store.windows(since="2024-01-01")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ >= ", plan) and re.search(r"PartitionFilters: \[[^\]]*batch_id", plan)


def test_killed_between_the_writes(spark, monkeypatch):
    """A batch that dies between log and snapshot, or before the manifest, shows nothing; its replay shows both."""
    root = scratch_path(spark, "store")
    sink = StoreSink(root)
    sink(_stats(spark, [("e1", "view", 0, 1.0)]), 0)
    store = WindowStore(spark, root)
    seen = (store.log().count(), _values(store.snapshot()))
    for step in ("_write_delta", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(WindowStore, step, lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError):
                sink(_stats(spark, [("e1", "view", 1, 2.0), ("e2", "view", 1, 3.0)]), 1)
        assert (store.log().count(), _values(store.snapshot())) == seen
    assert any("batch_id=1" in n for n in files.names(spark, f"{root}/log/dt=2024-01-01"))  # the rows are there, unseen
    sink(_stats(spark, [("e1", "view", 1, 2.0), ("e2", "view", 1, 3.0)]), 1)
    assert store.log().count() == 3 and _values(store.snapshot())[("e1", "avg_5min_view")] == 2.0
    sink(_stats(spark, [("e1", "view", 1, 99.0)]), 1)  # a batch that is committed already isn't written again
    assert store.log().count() == 3 and _values(store.snapshot())[("e1", "avg_5min_view")] == 2.0


def test_two_writers(spark):
    store = WindowStore(spark, scratch_path(spark, "store"))
    store.write_batch(_stats(spark, [("e1", "view", 0, 1.0)]), 0, 3600)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(store.head())
    assert files.write_once(spark, f"{store.root}/manifest/x.txt", "a") and not files.write_once(spark, f"{store.root}/manifest/x.txt", "b")
    assert files.read_text(spark, f"{store.root}/manifest/x.txt") == "a"


def _drain(spark, batches, closed):
    root = scratch_path(spark, "test-stream")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(os.path.join(local, "in"), exist_ok=True)
    seen = []
    for i, rows in enumerate(batches):
        with open(os.path.join(local, "in", f"b{i:03d}.json"), "w") as fh:
            for ts, value in rows:
                fh.write(json.dumps({"entity_id": "e1", "event_type": "purchase", "value": value, "timestamp": ts, "metadata": None}) + "\n")
        q = run_stream(spark.readStream.format("text").load(f"{root}/in"), f"{root}/store", f"{root}/ckpt", closed,
                      compact_every=2, trigger={"availableNow": True})
        q.awaitTermination()
        assert q.exception() is None
        snap = WindowStore(spark, f"{root}/store").snapshot()
        seen.append({} if snap is None else {r.feature_name: (r.value_num, r.value_ts.strftime("%H:%M")) for r in snap.collect()})
    return seen, WindowStore(spark, f"{root}/store")


def test_closed_windows_leave_once(spark):
    """No entry before the watermark passes a window's end; then its final value, each window once."""
    d = "2024-01-01T"
    batches = [[(d + "12:00:30", 1.0)], [(d + "12:00:40", 3.0)], [(d + "12:14:30", 50.0)], [(d + "12:30:00", 7.0)]]
    seen, store = _drain(spark, batches, True)
    assert seen[0] == {} and seen[1] == {}
    assert seen[2]["avg_5min_purchase_value"] == (2.0, "12:04")  # watermark 12:04:30
    assert seen[3]["max_5min_purchase"] == (50.0, "12:19")
    log = store.log()
    assert log.count() == log.select("entity_id", "window_start").distinct().count() == 10
    assert {r.n_events for r in log.where("avg_5min = 2.0").collect()} == {2}


def test_open_windows_in_update_mode(spark):
    seen, store = _drain(spark, [[("2024-01-01T12:00:30", 1.0)], [("2024-01-01T12:00:40", 3.0)]], False)
    assert seen[0]["avg_5min_purchase_value"] == (1.0, "12:05") and seen[1]["avg_5min_purchase_value"] == (2.0, "12:05")
    assert store.log().count() == 10 and store.windows().count() == 5

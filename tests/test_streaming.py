import datetime as dt
import json
import os

from pyspark.sql import functions as F

from chronoframe.operators.windows import current_windows
from chronoframe.session import scratch_path
from chronoframe.streaming.job import decode_events, run_stream
from chronoframe.streaming.store import WindowStore


def _line(ts, value, entity="e1", etype="purchase"):
    return json.dumps({"entity_id": entity, "event_type": etype, "value": value, "timestamp": ts,
                       "metadata": None})


def _drain(spark, batches):
    """One JSON file per batch; the stream restarts from its checkpoint with
    availableNow after each file, so each file is one micro-batch."""
    root = scratch_path(spark, "test-stream")
    root = root[len("file:"):] if root.startswith("file:") else root  # local test files
    src, store, ckpt = (os.path.join(root, x) for x in ("in", "store", "ckpt"))
    os.makedirs(src, exist_ok=True)
    dropped = 0
    for i, lines in enumerate(batches):
        with open(os.path.join(src, f"b{i:03d}.json"), "w") as fh:
            fh.write("\n".join(lines) + "\n")
        raw = spark.readStream.format("text").load(src)
        q = run_stream(raw, store, ckpt, closed=False, trigger={"availableNow": True})
        q.awaitTermination()
        assert q.exception() is None
        for p in q.recentProgress:
            for op in p.get("stateOperators") or []:
                dropped += op.get("numRowsDroppedByWatermark", 0)
    return WindowStore(spark, store).log(), WindowStore(spark, store).snapshot(), dropped


def test_late_rows_per_window(spark):
    d = "2024-01-01T"
    batches = [[_line(d + "12:30:00", 1.0)], [_line(d + "12:30:10", 1.0)],
               [_line(d + "12:30:20", 1.0), _line(d + "12:21:30", 1.0), _line(d + "12:18:30", 7.0),
                _line(d + "12:14:59", 9.0)],
               [_line(d + "13:30:00", 1.0)]]
    log, _, dropped = _drain(spark, batches)
    cur = current_windows(log)
    with_seven = sorted(r.window_start.strftime("%H:%M") for r in
                        cur.where(F.col("max_5min") == 7.0).collect())
    assert with_seven == ["12:16", "12:17", "12:18"]
    assert cur.where(F.col("max_5min") == 9.0).count() == 0
    assert dropped == 6


def test_update_reemission_collapses(spark):
    d = "2024-01-01T"
    log, snap, _ = _drain(spark, [[_line(d + "12:00:30", 1.0)], [_line(d + "12:00:40", 3.0)]])
    assert log.count() == 10  # each of 5 windows emitted twice (update mode)
    cur = current_windows(log).collect()
    assert len(cur) == 5 and all(r.avg_5min == 2.0 and r.n_events == 2 for r in cur)
    # online snapshot: avg/max per (entity, feature), newest window end wins
    s = {r.feature_name: r for r in snap.collect()}
    assert set(s) == {"avg_5min_purchase_value", "max_5min_purchase"}
    assert s["avg_5min_purchase_value"].value_num == 2.0
    assert s["avg_5min_purchase_value"].value_ts == dt.datetime(2024, 1, 1, 12, 5)


def test_decode_and_quarantine(spark):
    raw = spark.createDataFrame(
        [("not json",), (json.dumps({"entity_id": "e", "event_type": "x", "value": 1.0, "timestamp": "bad"}),),
         (json.dumps({"entity_id": "e", "event_type": "x", "value": 1.0,
                      "timestamp": "2024-01-01T14:22:00+02:00", "metadata": {}}),)], "value string")
    ev, quarantine = decode_events(raw)
    rows = ev.collect()
    assert len(rows) == 1 and rows[0].metadata == "{}"
    assert rows[0].timestamp.replace(tzinfo=None) == dt.datetime(2024, 1, 1, 12, 22) or \
        ev.select(F.date_format("timestamp", "HH:mm").alias("t")).collect()[0].t == "12:22"
    assert sorted(r.reason for r in quarantine.collect()) == ["bad_timestamp", "unparsed_or_no_entity"]

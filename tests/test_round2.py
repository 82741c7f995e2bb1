"""Rules that the registered queries' data doesn't reach."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronoframe.functions.scalars import glob_match, seconds_between
from chronoframe.operators import asof, features, online, pit, quality, registry, telemetry, windows, writes
from chronoframe.session import scratch_path
from chronoframe.sources import files
from chronoframe.streaming import job
from chronoframe.streaming.store import StoreSink, WindowStore

from helpers import registry_df, ts, values_df


def test_update_replaces_and_metadata_default(spark):
    cols = "feature_id int, value double, metadata string, write_seq long"
    old = spark.createDataFrame([(1, 10.0, None, 5), (2, 1.0, "{}", 1)], cols)
    new = spark.createDataFrame([(1, 20.0, None, 2)], cols)
    got = {r.feature_id: (r.value, r.metadata) for r in writes.upsert(old, new, ["feature_id"]).collect()}
    assert got == {1: (20.0, "{}"), 2: (1.0, "{}")}


def test_rewritten_day_keeps_other_days(spark):
    path = scratch_path(spark, "history")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        writes.write_history(values_df(spark, [(1, "a", "2024-01-01 10:00:00", 1.0, 1), (1, "a", "2024-01-02 10:00:00", 2.0, 2)]), path)
        writes.write_history(values_df(spark, [(1, "a", "2024-01-02 10:00:00", 3.0, 3)]), path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    assert sorted(r.value_num for r in spark.read.parquet(path).collect()) == [1.0, 3.0]


def test_unreadable_snapshot_raises(spark):
    root = scratch_path(spark, "snap")
    assert WindowStore(spark, root).snapshot() is None
    spark.createDataFrame([("x",)], "value string").write.text(f"{root}/delta/batch=1")
    files.write_once(spark, f"{root}/manifest/000000000001.json",
                     json.dumps({"seq": 1, "batch_id": 1, "base": None, "deltas": ["delta/batch=1"]}))
    with pytest.raises(Exception, match="(?i)parquet"):
        WindowStore(spark, root).snapshot().collect()


def test_quarantine_is_written_once(spark):
    root = scratch_path(spark, "bad")
    good = json.dumps({"entity_id": "e", "event_type": "x", "value": 1.0, "timestamp": "2024-01-01T12:00:00"})
    for lines in (["not json", good], [json.dumps({"entity_id": "e", "event_type": "x", "timestamp": "bad"})]):
        spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(f"{root}/in")
        raw = spark.readStream.format("text").load(f"{root}/in")
        job.run_quarantine(raw, f"{root}/out", f"{root}/ckpt", trigger={"availableNow": True}).awaitTermination()
    assert sorted(r.reason for r in spark.read.parquet(f"{root}/out").collect()) == ["bad_timestamp", "unparsed_or_no_entity"]


def test_replayed_batch_replaces_itself(spark):
    root = scratch_path(spark, "sink")
    sink = StoreSink(root)
    batch = spark.createDataFrame([("e", "purchase", ts("2024-01-01 12:00:00"), ts("2024-01-01 12:05:00"), 2.0, 0.0, 3.0, 1.0, 2)],
                                  "entity_id string, event_type string, window_start timestamp, window_end timestamp, "
                                  "avg_5min double, stddev_5min double, max_5min double, min_5min double, n_events long")
    for _ in range(2):
        sink(batch, 7)
    store = WindowStore(spark, root)
    assert store.log().count() == 1 and store.snapshot().count() == 2


def test_request_of_1001_entities(spark):
    reg = registry_df(spark, [(1, "f", 1, 24)])
    vals = values_df(spark, [(1, f"u{i}", "2024-01-01 00:00:00", float(i), i) for i in range(1001)])
    ask = spark.createDataFrame([(1, [f"u{i}" for i in range(1001)], ["f"], ts("2024-01-02 00:00:00")), (2, [], ["f"], ts("2024-01-02 00:00:00")),
                                 (3, None, None, None)], "request_id int, entity_ids array<string>, feature_names array<string>, as_of timestamp_ntz")
    hits, rejects = pit.batch_retrieval(vals, reg, ask)
    assert hits.count() == 1001 and hits.first().entities_returned == 1001
    assert {r.request_id for r in rejects.collect()} == {2, 3}
    hits, rejects = pit.batch_retrieval(vals, reg, ask, max_entities=1000)
    assert hits.count() == 0 and {r.request_id: r.violations for r in rejects.collect()}[1] == ["too_many_entities"]


def test_null_entity_finds_nothing(spark):
    reg = registry_df(spark, [(1, "f", 1, 24)])
    vals = values_df(spark, [(1, None, "2024-01-01 00:00:00", 7.0, 1), (1, "a", "2024-01-01 00:00:00", 1.0, 2)])
    spine = spark.createDataFrame([(None, ts("2024-01-01 01:00:00")), ("a", ts("2024-01-01 01:00:00"))], "entity_id string, label_ts timestamp_ntz")
    assert {r.entity_id: r.f for r in asof.as_of_join(spine, vals, reg, ["f"]).collect()} == {None: None, "a": 1.0}


def test_differences_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(ts("2024-03-10 01:30:00"), ts("2024-03-10 03:30:00.25"))], "a timestamp_ntz, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(seconds_between("b", "a").alias("s")).first().s == 7200.25
        assert df.select(seconds_between("a", "b").alias("s")).first().s == -7200.25
        bucket = df.select(asof.time_bucket(F.col("b"), 3600).alias("x"), asof.time_bucket(F.col("a"), 3600).alias("y")).first()
        assert bucket.x - bucket.y == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_predicates_by_type(spark):
    df = spark.createDataFrame([('{"a": true}',), ('{"a": 10.0}',), ('{"a": 10}',), ('{"a": "10"}',), ('{"a": "true"}',), ("bad",), (None,),
                                ('{"a": 9007199254740993}',)], "j string")

    def n(v):
        return df.where(quality.json_path_equals("j", "$.a", v)).count()

    assert (n(True), n(10), n(10.0), n("10"), n("true"), n(False), n(9007199254740993), n(9007199254740992)) == (1, 2, 2, 1, 1, 0, 1, 0)


def test_globs(spark):
    df = spark.createDataFrame([("a*b",), ("axb",), ("a[b",), ("a\\b",), ("a-b",), ("ab",)], "k string")

    def hits(p):
        return sorted(r.k for r in df.where(glob_match("k", p)).collect())

    assert hits("a\\*b") == ["a*b"] and hits("a[]b") == [] and hits("a[!x]b") == ["a*b", "a-b", "a[b", "a\\b"]
    assert hits("a?b") == ["a*b", "a-b", "a[b", "a\\b", "axb"] and hits("a[x-]b") == ["a-b", "axb"] and hits("a\\[b") == ["a[b"]


def test_snapshot_keeps_values_of_any_type(spark):
    u = spark.createDataFrame([("u", "s", None, '"text"', 1), ("u", "o", None, '{"a":[1]}', 2), ("u", "i", 9007199254740992.0, "9007199254740993", 3),
                               ("u", "none", None, None, 4)], "entity_id string, feature_name string, value_num double, value_json string, write_seq long")
    u = u.withColumn("value_ts", F.lit(ts("2024-01-01 00:00:00")).cast("timestamp_ntz")).withColumn("written_at", F.col("value_ts"))
    got = {r.feature_name: r.value_json for r in online.snapshot_merge(None, u).collect()}
    assert got == {"s": '"text"', "o": '{"a":[1]}', "i": "9007199254740993"}


def test_closed_windows_only(spark):
    stats = spark.createDataFrame([("e", "purchase", ts(f"2024-01-01 11:{56 + i}:00"), dt.datetime(2024, 1, 1, 12, i + 1), float(i), 0.0, 0.0, 0.0)
                                   for i in range(4)], "entity_id string, event_type string, window_start timestamp_ntz, window_end timestamp_ntz, "
                                  "avg_5min double, stddev_5min double, max_5min double, min_5min double")
    u = online.stream_updates(stats, 1, as_of="2024-01-01 12:02:00")
    snap = {r.feature_name: r for r in online.snapshot_merge(None, u).collect()}
    assert snap["avg_5min_purchase_value"].value_num == 1.0 and snap["avg_5min_purchase_value"].value_ts == dt.datetime(2024, 1, 1, 12, 2)


def test_definition_rejects_and_kafka_options(spark):
    reg = registry_df(spark, [(1, "f", 1, 24)])
    defs = spark.createDataFrame([("", 1, "float64", "user"), ("g", 0, "float64", "user"), ("h", 1, "float64", "user")],
                                 "name string, version int, dtype string, entity_type string")
    now, rejects = registry.register_with_rejects(reg, defs, "2024-02-01 00:00:00")
    assert {r.name for r in now.collect()} == {"f", "h"} and {r.name for r in rejects.collect()} == {"", "g"}
    assert job.kafka_options("h:9092", "events", "earliest", 1000, False) == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "events", "startingOffsets": "earliest",
        "failOnDataLoss": "false", "maxOffsetsPerTrigger": "1000"}


def test_as_of_and_replay_carry_any_json(spark):
    reg = registry_df(spark, [(1, "s", 1, 24, "string"), (2, "i", 1, 24, "int64")])
    vals = values_df(spark, [(1, "a", "2024-01-01 00:00:00", None, 1), (2, "a", "2024-01-01 00:00:00", None, 2)]) \
        .withColumn("value_json", F.when(F.col("feature_id") == 1, '"x"').otherwise("9007199254740993"))
    spine = spark.createDataFrame([("a", ts("2024-01-01 01:00:00"))], "entity_id string, label_ts timestamp_ntz")
    row = asof.as_of_join(spine, vals, reg, ["s", "i"], value="value_json").first()
    assert (row.s, row.i) == ('"x"', "9007199254740993")
    snap = online.snapshot_merge(None, spark.createDataFrame(
        [("a", "s", None, '"x"', 1)], "entity_id string, feature_name string, value_num double, value_json string, write_seq long")
        .withColumn("value_ts", F.lit(ts("2024-01-01 00:00:00"))).withColumn("written_at", F.col("value_ts")))
    ask = spark.createDataFrame([(1, "a", ["s", "i"], ts("2024-01-01 00:30:00"))],
                                "request_id int, entity_id string, feature_names array<string>, request_ts timestamp_ntz")
    answers, after = online.replay(snap, vals, reg, ask)
    assert {r.feature_name: (r.value_json, r.hit) for r in answers.collect()} == {"s": ('"x"', True), "i": ("9007199254740993", False)}
    assert {r.feature_name: r.value_json for r in after.collect()} == {"s": '"x"', "i": "9007199254740993"}


def test_as_of_bounds_prune_days(spark):
    from chronoframe.plans.guards import physical_plan

    path = scratch_path(spark, "bounded")
    writes.write_history(values_df(spark, [(1, "a", f"2024-01-{d:02d} 10:00:00", float(d), d) for d in range(1, 10)]), path)
    reg = registry_df(spark, [(1, "f", 1, 48)])
    spine = spark.createDataFrame([("a", ts("2024-01-05 09:00:00")), ("a", ts("2024-01-06 09:00:00"))], "entity_id string, label_ts timestamp_ntz")
    for ttl, filters in ((False, 1), (True, 2)):
        got = asof.as_of_join(spine, spark.read.parquet(path), reg, ["f"], apply_ttl=ttl)
        scan = [line for line in physical_plan(got).splitlines() if "PartitionFilters" in line and "dt" in line]
        assert scan and all(line.count("subquery") >= filters for line in scan), scan
        assert sorted(r.f for r in got.collect()) == [4.0, 5.0]
    empty = spine.where("entity_id = 'none'")
    assert asof.as_of_join(empty, spark.read.parquet(path), reg, ["f"]).count() == 0


def test_sessions_across_day_edges(spark):
    import random

    rnd = random.Random(3)
    rows = [(f"u{rnd.randint(0, 2)}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * rnd.randint(0, 1000))) for _ in range(700)]
    rows += [("edge", dt.datetime(2024, 1, 1, 23, 45)), ("edge", dt.datetime(2024, 1, 2, 0, 15)), ("edge", dt.datetime(2024, 1, 2, 0, 46))]
    df = spark.createDataFrame(rows, "entity_id string, timestamp timestamp_ntz")
    want = []
    for e in {r[0] for r in rows}:
        run = []
        for t in sorted(r[1] for r in rows if r[0] == e):
            if run and t - run[-1] > dt.timedelta(minutes=30):
                want.append((e, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((e, run[0], run[-1], len(run)))
    for bucket in ("1 day", "1 hour"):
        got = features.sessions(df, "30 minutes", bucket=bucket)
        assert sorted((r.entity_id, r.session_start, r.session_end, r.n_events) for r in got.collect()) == sorted(want)


def test_exact_quantiles_by_value_range(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=2000).round(3).tolist(), "b": [1.0] * 50, None: [3.0, 1.0], "c": [-2.5]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("d", None)], "g string, x double")
    for ranges in (4, 256):
        got = {r.g: r for r in telemetry.exact_quantiles(df, ["g"], "x", telemetry.QUANTILES, ranges).collect()}
        assert set(got) == set(data)
        for g, vs in data.items():
            for name, q in telemetry.QUANTILES.items():
                assert abs(got[g][name] - float(np.quantile(vs, q))) < 1e-9


def test_window_merge_touches_its_days_only(spark):
    path = scratch_path(spark, "merge")
    writes.write_history(values_df(spark, [(1, "a", "2024-01-01 12:05:00", 1.0, 9), (1, "a", "2024-01-02 12:05:00", 2.0, 9)]), path)
    reg = registry_df(spark, [(1, "avg_5min_purchase_value", 1, 24)])
    feats = spark.createDataFrame([("a", "avg_5min_purchase_value", 5.0, ts("2024-01-01 12:05:00")), ("a", "max_5min_click", 6.0, ts("2024-01-03 12:05:00"))],
                                  "entity_id string, feature_name string, value_num double, event_ts timestamp_ntz")
    merged, unresolved = windows.merge_into_history(feats, reg, spark.read.parquet(path), 1)
    assert [(r.value_num, str(r.dt), r.metadata) for r in merged.collect()] == [(5.0, "2024-01-01", "{}")]
    assert [tuple(r) for r in unresolved.collect()] == [("max_5min_click", 1)]

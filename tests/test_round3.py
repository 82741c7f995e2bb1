import datetime as dt

from chronoframe.operators import online, pit
from chronoframe.operators import registry as reg
from chronoframe.plans import catalog
from chronoframe.session import cut_lineage, scratch_path, written
from chronoframe.sources import files
from chronoframe.streaming.store import WindowStore

AT = dt.datetime(2024, 1, 1, 12)


def _answers(spark):
    registry = reg.register(spark.createDataFrame([], catalog.A.schemas.REGISTRY), spark.createDataFrame(
        [("kind", 1, "string", "user", 24, "", ["t"])], catalog.A.schemas.DEFINITION), "2024-01-01 00:00:00")
    fid = registry.first()["feature_id"]
    values = spark.createDataFrame(
        [(fid, u, AT, '"v"', None, 1) for u in ("a", "b")],
        "feature_id int, entity_id string, event_ts timestamp_ntz, value_json string, value_num double, write_seq long")
    later = AT + dt.timedelta(hours=1)
    requests = spark.createDataFrame(
        [(1, ["a", "b", "c"], ["kind"], later), (2, ["a"], ["kind"], later), (2, ["a", "b"], ["kind"], later),
         (3, ["c"], ["kind"], later), (None, ["a"], ["kind"], later)],
        "request_id long, entity_ids array<string>, feature_names array<string>, as_of timestamp_ntz")
    return pit.batch_retrieval(values, registry, requests)[0]


def test_batch_retrieval_counts_entities_of_repeated_requests(spark):
    rows = sorted((r.request_id, r.entity_id, r.entities_returned) for r in _answers(spark).collect())
    assert rows == [(1, "a", 2), (1, "b", 2), (2, "a", 2), (2, "a", 2), (2, "b", 2)]


def test_batch_retrieval_scans_once(spark):
    """the entities are counted without a second as-of join."""
    plan = _answers(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("last(_v" in line and "Window [" in line for line in plan.splitlines()) == 2  # carry-in and scan


def test_log_of_a_batch_has_few_files(spark):
    """the files of a batch follow its rows, not the tasks that made them."""
    root = scratch_path(spark, "few-files")
    rows = [(f"u{i}", "purchase", AT + dt.timedelta(days=i % 2), AT + dt.timedelta(days=i % 2, minutes=5), float(i), None, float(i), float(i), 1, AT)
            for i in range(200)]
    stats = spark.createDataFrame(rows, "entity_id string, event_type string, window_start timestamp, window_end timestamp, avg_5min double, "
                                        "stddev_5min double, max_5min double, min_5min double, n_events long, last_updated timestamp").repartition(16)
    store = WindowStore(spark, root)
    assert store.write_batch(stats, 0, 3600)
    log = store.log()
    assert log.count() == 200 and len(log.inputFiles()) == 2
    assert len(store.snapshot().inputFiles()) == 1


def test_json_of_the_newest_write_alone(spark):
    u = spark.createDataFrame([("a", "f", 1.5, AT, AT, 1), ("a", "f", float("nan"), AT, AT, 2), ("b", "f", None, AT, AT, 1), ("c", "f", 0.0, AT, AT, 1)],
                              "entity_id string, feature_name string, value_num double, value_ts timestamp_ntz, written_at timestamp_ntz, write_seq long")
    merged = online.snapshot_merge(None, u)
    assert {r.entity_id: r.value_json for r in merged.collect()} == {"a": "NaN", "c": "0.0"}
    lines = merged._jdf.queryExecution().analyzed().toString().splitlines()
    json, aggregate = (next(i for i, line in enumerate(lines) if w in line) for w in ("to_json", "Aggregate"))
    assert json < aggregate  # above the aggregate


def test_merged_days_are_written_compressed(spark):
    """a whole table between two writes is no row-wise checkpoint."""
    df = spark.range(50_000).selectExpr("id div 100 as k", "concat('entity_', cast(id div 100 as string)) as e")
    copy, checkpoint = written(df, "copy"), cut_lineage(df)
    assert copy.exceptAll(checkpoint).isEmpty() and copy.count() == 50_000
    assert files.tree_size(spark, copy.inputFiles()[0].rsplit("/", 1)[0])[1] < 200_000
    assert not hasattr(catalog, "cut_lineage")

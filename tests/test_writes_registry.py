from helpers import registry_df, ts
from pyspark.sql import functions as F

from chronoframe import schemas
from chronoframe.operators import registry as reg
from chronoframe.operators import writes


def _rows(spark, rows):
    return spark.createDataFrame([(e, ts(t), v, s) for e, t, v, s in rows],
                                 "entity_id string, event_ts timestamp_ntz, value_num double, write_seq long")


def test_upsert_last_wins_and_idempotent(spark):
    h = _rows(spark, [("k", "2024-01-01 00:00:00", 10.0, 1)])
    u = _rows(spark, [("k", "2024-01-01 00:00:00", 20.0, 2), ("j", "2024-01-01 00:00:00", 5.0, 3)])
    once = writes.upsert(h, u, ["entity_id", "event_ts"])
    twice = writes.upsert(once, u, ["entity_id", "event_ts"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {r.entity_id: r.value_num for r in once.collect()} == {"k": 20.0, "j": 5.0}
    empty = writes.upsert(h, u.limit(0), ["entity_id", "event_ts"])
    assert [r.value_num for r in empty.collect()] == [10.0]


def test_insert_ignore_first_wins(spark):
    h = _rows(spark, [("k", "2024-01-01 00:00:00", 10.0, 1)])
    u = _rows(spark, [("k", "2024-01-01 00:00:00", 20.0, 2), ("j", "2024-01-01 00:00:00", 7.0, 4),
                      ("j", "2024-01-01 00:00:00", 5.0, 3)])
    out = {r.entity_id: r.value_num for r in writes.insert_ignore(h, u, ["entity_id", "event_ts"]).collect()}
    assert out == {"k": 10.0, "j": 5.0}


def test_register_keeps_id_and_created_at(spark):
    r0 = registry_df(spark, [(1, "a", 1, 24), (2, "b", 1, 24)])
    defs = spark.createDataFrame([("a", 1, "float64", "user", 48, "new", None),
                                  ("test_feature_new", None, "int64", "user", None, None, ["test", "unit-test"]),
                                  ("", 1, "int64", "user", 1, "", None)], schema=schemas.DEFINITION)
    out = {r.name: r for r in reg.register(r0, defs, "2024-02-01 00:00:00").collect()}
    assert out["a"].feature_id == 1 and out["a"].ttl_hours == 48
    assert out["a"].created_at == ts("2024-01-01 00:00:00") and out["a"].updated_at == ts("2024-02-01 00:00:00")
    assert out["test_feature_new"].feature_id == 3 and out["test_feature_new"].ttl_hours == 24
    assert out["test_feature_new"].version == 1 and out["test_feature_new"].description == ""
    assert "" not in out  # invalid definition not applied
    assert out["b"].updated_at == ts("2024-01-01 00:00:00")


def test_validate_definitions(spark):
    defs = spark.createDataFrame([("x" * 256, 0, None, "user", 0, None, None)], schema=schemas.DEFINITION)
    v = reg.validate_definitions(defs).collect()[0]
    assert not v.valid and set(v.violations) == {"name_too_long", "version_lt_1", "ttl_lt_1", "dtype_missing"}


def test_group_dangling(spark):
    from chronoframe.sources.adapters import build_registry, feature_groups
    from conftest import SF
    ev = spark.read.parquet(f"{SF}/events.parquet")
    _, dangling = reg.expand_groups(feature_groups(spark), build_registry(spark, ev))
    assert {r.member for r in dangling.collect()} >= {
        "user_gender", "user_location", "avg_purchase_value", "active_session_count"}

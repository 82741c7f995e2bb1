from helpers import registry_df, ts, values_df
from pyspark.sql import functions as F

from chronoframe.functions.scalars import decode_json_value, glob_to_regex, split_online_key
from chronoframe.operators import online, quality


def _snap(spark):
    u = spark.createDataFrame(
        [("user_batch", f"feature_{i}", float(i * 10), ts("2024-01-01 11:00:00"), ts("2024-01-01 12:00:00"), i)
         for i in range(5)] +
        [("user_123", f"feature_{i}", 1.0, ts("2024-01-01 11:00:00"), ts("2024-01-01 12:00:00"), 10 + i)
         for i in range(3)],
        "entity_id string, feature_name string, value_num double, value_ts timestamp_ntz, "
        "written_at timestamp_ntz, write_seq long")
    return online.snapshot_merge(None, u, 3600)


def _req(spark, rows):
    return spark.createDataFrame([(i, e, f, ts(t)) for i, e, f, t in rows],
                                 "request_id long, entity_id string, feature_names array<string>, "
                                 "request_ts timestamp_ntz")


def test_expiry_boundary(spark):
    req = _req(spark, [(1, "user_batch", ["feature_0"], "2024-01-01 12:59:59"),
                       (2, "user_batch", ["feature_0"], "2024-01-01 13:00:00")])
    got = {r.request_id: r.hit for r in online.probe(_snap(spark), req).collect()}
    assert got == {1: True, 2: False}


def test_get_many_all_hit(spark):
    req = _req(spark, [(1, "user_batch", [f"feature_{i}" for i in range(5)], "2024-01-01 12:30:00")])
    p = online.probe(_snap(spark), req).orderBy("pos").collect()
    assert [r.cached_value for r in p] == [0.0, 10.0, 20.0, 30.0, 40.0] and all(r.hit for r in p)


def test_invalidate_pattern_counts_three(spark):
    remaining, removed = online.invalidate(_snap(spark), pattern="user_123:*")
    assert removed.collect()[0].removed == 3
    assert remaining.where(F.col("entity_id") == "user_123").count() == 0
    _, removed2 = online.invalidate(_snap(spark), entities=["user_123"])
    assert removed2.collect()[0].removed == 3


def test_replay_fallback_and_writeback(spark):
    reg = registry_df(spark, [(1, "feature_0", 1, 24), (2, "feature_9", 1, 24)])
    vals = values_df(spark, [(2, "user_batch", "2024-01-01 10:00:00", 99.0, 1)])
    req = _req(spark, [(1, "user_batch", ["feature_0", "feature_9", "nope"], "2024-01-01 12:30:00")])
    answers, snap = online.replay(_snap(spark), vals, reg, req)
    got = {r.feature_name: (r.value_num, r.hit, r.source) for r in answers.collect()}
    assert got == {"feature_0": (0.0, True, "database"), "feature_9": (99.0, False, "database")}
    wb = snap.where("feature_name = 'feature_9'").collect()[0]
    assert wb.written_at == ts("2024-01-01 12:30:00") and wb.expires_at == ts("2024-01-01 13:30:00")


def test_zero_kept_null_skipped(spark):
    u = spark.createDataFrame([("e", "f0", 0.0, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"), 1),
                               ("e", "f1", None, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"), 1)],
                              "entity_id string, feature_name string, value_num double, value_ts timestamp_ntz, "
                              "written_at timestamp_ntz, write_seq long")
    s = online.snapshot_merge(None, u).collect()
    assert [(r.feature_name, r.value_num) for r in s] == [("f0", 0.0)]


def test_json_decode_by_dtype(spark):
    cases = [("25", "int64", "25"), ("1500.5", "float64", "1500.5"), ('"x"', "string", "x"),
             ("true", "bool", "true"), ('{"a":[1]}', "int64", None), ("null", "float64", None),
             ('"x"', "int64", None), ("25", "float64", "25.0")]
    df = spark.createDataFrame(cases, "v string, d string, want string")
    for r in df.select(decode_json_value("v", "d").alias("got"), "want").collect():
        assert r.got == r.want


def test_key_split_and_glob(spark):
    df = spark.createDataFrame([("a:b:feat",)], "k string")
    e, f = split_online_key("k")
    r = df.select(e.alias("e"), f.alias("f")).collect()[0]
    assert (r.e, r.f) == ("a:b", "feat")
    assert glob_to_regex("user_1*:p?") == "(?s)^user_1.*:p.\\z"


def test_validate_requests_oversize(spark):
    req = spark.createDataFrame([(1, [f"u{i}" for i in range(1001)], ["f"]), (2, ["u"], ["f"])],
                                "request_id long, entity_ids array<string>, feature_names array<string>")
    v = {r.request_id: r.valid for r in quality.validate_requests(req).collect()}
    assert v == {1: False, 2: True}

from helpers import ts
from pyspark.sql import functions as F

from chronoframe.operators import features, telemetry, windows


def _ev(spark, rows):
    return spark.createDataFrame([(e, t_, v, ts(s), i) for i, (e, t_, v, s) in enumerate(rows)],
                                 "entity_id string, event_type string, value double, timestamp timestamp_ntz, "
                                 "event_id long")


def test_one_row_window_stddev_null_and_five_windows(spark):
    s = windows.window_stats(_ev(spark, [("u", "purchase", 10.0, "2024-01-01 12:00:30")])).collect()
    assert len(s) == 5 and all(r.stddev_5min is None and r.avg_5min == 10.0 for r in s)


def test_stats_to_features_name_map_and_zero(spark):
    s = windows.window_stats(_ev(spark, [("u", "purchase", 0.0, "2024-01-01 12:00:30")]))
    f = windows.stats_to_features(s).collect()
    names = {r.feature_name for r in f}
    assert names == {"avg_5min_purchase_value", "max_5min_purchase"} and all(r.value_num == 0.0 for r in f)


def test_trailing_count_matches_bruteforce(spark):
    import random
    rnd = random.Random(3)
    rows = [("u", "purchase", 1.0, f"2024-01-{rnd.randint(1, 28):02d} {rnd.randint(0, 23):02d}:00:00")
            for _ in range(120)]
    got = sorted((r.event_id, r.c) for r in features.trailing_count(
        _ev(spark, rows), "7 days", out="c").collect())
    tss = [ts(r[3]) for r in rows]
    import datetime as dt
    want = sorted((i, sum(1 for u in tss if t - dt.timedelta(days=7) <= u <= t)) for i, t in enumerate(tss))
    assert got == want


def test_sessions_span_bucket_edges(spark):
    rows = [("u", "view", 1.0, "2024-01-01 23:50:00"), ("u", "view", 1.0, "2024-01-02 00:10:00"),
            ("u", "view", 1.0, "2024-01-02 00:39:59"), ("u", "view", 1.0, "2024-01-02 01:09:59")]
    s = features.sessions(_ev(spark, rows), "30 minutes").orderBy("session_start").collect()
    # stitched across the day edge; a gap of exactly 30 min stays in the session
    assert [(r.n_events, r.session_duration_seconds) for r in s] == [(4, 4799)]
    s2 = features.sessions(_ev(spark, rows + [("u", "view", 1.0, "2024-01-02 01:40:00")]), "30 minutes")
    assert sorted(r.n_events for r in s2.collect()) == [1, 4]


def test_conversion_zero_views_null(spark):
    p = spark.createDataFrame([("product_1", "purchase")], "entity_id string, event_type string")
    r = features.product_view_stats(p).collect()[0]
    assert r.product_view_count == 0 and r.product_conversion_rate is None


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 50, 501)]
    df = spark.createDataFrame([("e", v, 200) for v in vals], "endpoint string, latency_ms double, status int")
    s = telemetry.latency_summary(df).collect()[0]
    for name, q in (("median_ms", 0.5), ("p90_ms", 0.9), ("p99_ms", 0.99)):
        assert abs(getattr(s, name) - float(np.quantile(vals, q))) < 1e-9
    assert abs(s.stddev_ms - float(np.std(vals))) < 1e-9

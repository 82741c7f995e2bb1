import datetime as dt

from chronoframe import schemas


def ts(s):
    return dt.datetime.fromisoformat(s)


def registry_df(spark, rows):
    """rows: (feature_id, name, version, ttl_hours[, dtype])"""
    full = []
    for r in rows:
        fid, name, ver, ttl = r[:4]
        dtype = r[4] if len(r) > 4 else "float64"
        full.append((fid, name, ver, dtype, "user", ttl, "", [], ts("2024-01-01 00:00:00"),
                     ts("2024-01-01 00:00:00")))
    return spark.createDataFrame(full, schema=schemas.REGISTRY)


def values_df(spark, rows):
    """rows: (feature_id, entity_id, event_ts, value_num, write_seq)"""
    return spark.createDataFrame(
        [(f, e, ts(t), None if v is None else str(v), v, None, s) for f, e, t, v, s in rows],
        schema=schemas.FEATURE_VALUES)

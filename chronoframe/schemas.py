"""Canonical schemas of the engine's tables.

Timestamps are TIMESTAMP_NTZ in batch tables (the driver's parquet is NTZ and
the session zone is UTC); the streaming path converts event time to
TIMESTAMP because watermarks require it.
"""

from pyspark.sql import types as T

REGISTRY = T.StructType([
    T.StructField("feature_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("ttl_hours", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

DEFINITION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("ttl_hours", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

FEATURE_VALUES = T.StructType([
    T.StructField("feature_id", T.IntegerType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("value_json", T.StringType()),
    T.StructField("value_num", T.DoubleType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("write_seq", T.LongType()),
])

# JSON payload of one raw event (the Kafka ``value``).
EVENT_JSON = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

GROUPS = T.StructType([
    T.StructField("group", T.StringType()),
    T.StructField("members", T.ArrayType(T.StringType())),
])

API_KEYS = T.StructType([
    T.StructField("api_key", T.StringType()),
    T.StructField("tenant", T.StringType()),
])

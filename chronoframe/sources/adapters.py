"""Adapters from the driver's tables to the engine's domain tables.

All are projections/joins over the given tables, so their work grows with
the data.  Rules are stated once here and mirrored by the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.registry import register
from ..session import table_path

# --- fixed values -----------------------------------------------------------
# Registry seed rows of the reference's DDL: name, version, dtype,
# entity_type, ttl_hours, description, tags.
SEED_DEFINITIONS = [
    ("user_age", 1, "int64", "user", 24, "User age in years", ["demographic"]),
    ("user_lifetime_value", 1, "float64", "user", 24, "Predicted customer lifetime value",
     ["revenue", "prediction"]),
    ("last_purchase_days", 1, "int64", "user", 24, "Days since last purchase", ["engagement"]),
    ("avg_5min_purchase_value", 1, "float64", "user", 1, "5-minute average purchase value",
     ["realtime", "revenue"]),
    ("product_view_count", 1, "int64", "product", 24, "Total product views", ["engagement"]),
]
# Feature groups of the reference's catalogue (group -> members, in order).
FEATURE_GROUPS = [
    ("user_demographics", ["user_age", "user_gender", "user_location"]),
    ("user_behavior", ["last_purchase_days", "purchase_count_7d", "avg_purchase_value"]),
    ("realtime_metrics", ["avg_5min_purchase_value", "active_session_count"]),
    ("product_metrics", ["product_view_count", "product_conversion_rate"]),
]
# API key -> tenant of the reference's auth module.
API_KEYS = [("tenant1_key", "tenant1"), ("tenant2_key", "tenant2"), ("dev_key", "development")]

# --- adapter rules (ours) -----------------------------------------------------
REGISTRY_AS_OF = "2024-01-01 00:00:00"     # registration time of the derived registry
PURCHASE_V2_FROM = "2024-01-15 00:00:00"   # purchase values from here on are version 2
EVENT_TTL_HOURS = 24                      # ttl of every event-derived v1 definition
PURCHASE_V2_TTL_HOURS = 72


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def user_entity(user_id_col: str = "user_id"):
    return F.concat(F.lit("user_"), F.col(user_id_col).cast("string"))


def domain_events(events: DataFrame) -> DataFrame:
    """events -> (entity_id, event_type, value, timestamp, metadata, event_id)."""
    return events.select(
        user_entity().alias("entity_id"),
        "event_type", "value",
        F.col("ts").alias("timestamp"),
        F.col("props").alias("metadata"),
        "event_id",
    )


def seed_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_DEFINITIONS, schema=schemas.DEFINITION)


def event_definitions(events: DataFrame) -> DataFrame:
    """One float64 user definition per observed event type (version 1), and
    version 2 of ``purchase`` (pooled with v1 by name on read)."""
    types = events.select(F.col("event_type").alias("name")).distinct()
    v1 = types.select(
        "name", F.lit(1).alias("version"), F.lit("float64").alias("dtype"),
        F.lit("user").alias("entity_type"), F.lit(EVENT_TTL_HOURS).alias("ttl_hours"),
        F.concat(F.col("name"), F.lit(" event value")).alias("description"),
        F.array(F.lit("event"), F.col("name")).alias("tags"))
    v2 = types.where(F.col("name") == "purchase").select(
        "name", F.lit(2).alias("version"), F.lit("float64").alias("dtype"),
        F.lit("user").alias("entity_type"), F.lit(PURCHASE_V2_TTL_HOURS).alias("ttl_hours"),
        F.lit("purchase event value, v2").alias("description"),
        F.array(F.lit("event"), F.lit("purchase"), F.lit("v2")).alias("tags"))
    return v1.unionByName(v2)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema=schemas.REGISTRY)


def build_registry(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Seed definitions plus event-derived ones, registered (G1) at once."""
    defs = seed_definitions(spark).unionByName(event_definitions(events))
    return register(empty_registry(spark), defs, REGISTRY_AS_OF)


def event_version():
    return F.when((F.col("event_type") == "purchase") &
                  (F.col("ts") >= F.lit(PURCHASE_V2_FROM).cast("timestamp_ntz")), 2).otherwise(1)


def values_from_events(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Feature history from events: feature = event_type (resolved to an id
    through the registry), write_seq = event_id."""
    reg = (registry.select(F.col("name").alias("event_type"), "version", "feature_id"))
    ev = events.select(
        "event_type", event_version().alias("version"),
        user_entity().alias("entity_id"),
        F.col("ts").alias("event_ts"),
        F.col("value").cast("string").alias("value_json"),
        F.col("value").alias("value_num"),
        F.col("props").alias("metadata"),
        F.col("event_id").alias("write_seq"),
    )
    return ev.join(reg, ["event_type", "version"]).select(*schemas.FEATURE_VALUES.fieldNames())


def order_updates(orders: DataFrame) -> DataFrame:
    """Orders as history writes with key conflicts: key (customer, order
    date), value = total price, write order = order key."""
    return orders.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("entity_id"),
        F.col("o_orderdate").alias("event_ts"),
        F.col("o_totalprice").alias("value_num"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("write_seq"),
    )


def spine_from_events(events: DataFrame, event_type: str = "signup") -> DataFrame:
    """Training spine: one row per ``signup`` event."""
    return events.where(F.col("event_type") == event_type).select(
        F.col("event_id").alias("spine_id"), user_entity().alias("entity_id"),
        F.col("ts").alias("label_ts"))


def product_events(events: DataFrame) -> DataFrame:
    """Product-keyed events: product = ``props.k``."""
    return events.select(
        F.concat(F.lit("product_"), F.get_json_object("props", "$.k")).alias("entity_id"),
        "event_type", F.col("ts").alias("timestamp"), "value", "event_id")


def api_key_rule():
    """Request api_key from ``props.k``: 0-39 tenant1, 40-69 tenant2,
    70-89 dev, 90-94 an unknown key, 95-99 none."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (F.when(k < 40, "tenant1_key").when(k < 70, "tenant2_key")
            .when(k < 90, "dev_key").when(k < 95, "revoked_key"))


def request_log(events: DataFrame) -> DataFrame:
    """Serving log: one request per event; latency_ms = value; endpoint from
    the event type; status 500 for ``error`` events."""
    endpoint = (F.when(F.col("event_type").isin("view", "click"), "/features/online")
                .when(F.col("event_type") == "purchase", "/features/batch")
                .when(F.col("event_type") == "signup", "/features/register")
                .otherwise("/features/invalidate"))
    return events.select(
        F.col("event_id").alias("request_id"),
        api_key_rule().alias("api_key"),
        endpoint.alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        user_entity().alias("entity_id"),
        F.col("ts").alias("request_ts"),
        F.col("value").alias("latency_ms"),
    )


def api_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(API_KEYS, schema=schemas.API_KEYS)


def feature_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURE_GROUPS, schema=schemas.GROUPS)

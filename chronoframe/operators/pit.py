"""Point-in-time reads over the feature history (J1, J2, F1-F4, V4, J8, W1,
T1, T2, H1, H2, R2, R3, R6, R7).

``point_in_time`` answers "newest value at or before T" per (entity, feature
name) with one aggregation: ``max_by(payload, (ts, version, write_seq))``.
It aggregates partially before the shuffle, so a hot entity is reduced to one
row per map task and feature before it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import add_hours, seconds_between, ts_lit
from .registry import latest_versions

PAYLOAD = ["value_num", "value_json", "event_ts", "metadata", "feature_id", "feature_version", "write_seq"]


def _registry_side(registry: DataFrame, features=None, versions: str = "all") -> DataFrame:
    r = registry
    if features is not None:
        r = r.where(F.col("name").isin(list(features)))
    if versions == "latest":
        r = latest_versions(r)
    return (r.select(
        "feature_id", F.col("name").alias("feature_name"),
        F.col("version").alias("feature_version"), "ttl_hours", "dtype"))


def _restrict_entities(values: DataFrame, entities) -> DataFrame:
    """a Python list becomes an IN filter (pushed to the scan); a
    DataFrame a left-semi join (Spark picks the strategy from its measured size)."""
    if entities is None:
        return values
    if isinstance(entities, DataFrame):
        keys = entities.select(F.col(entities.columns[0]).alias("entity_id")).distinct()
        return values.join(keys, "entity_id", "left_semi")
    return values.where(F.col("entity_id").isin(list(entities)))


def resolved_values(values: DataFrame, registry: DataFrame, features=None,
                    versions: str = "all", entities=None) -> DataFrame:
    """Values joined to their definition (a dimension table; Spark broadcasts it while it is small)."""
    v = _restrict_entities(values, entities)
    return v.join(_registry_side(registry, features, versions), "feature_id")


def bound_upper(values: DataFrame, as_of) -> DataFrame:
    """F3 inclusive ``ts <= T``; with a ``dt`` partition column also the
    ``dt <= date(T)`` predicate that prunes partitions."""
    t = ts_lit(as_of)
    v = values.where(F.col("event_ts") <= t)
    if "dt" in values.columns:
        v = v.where(F.col("dt") <= F.to_date(t))
    return v


def point_in_time(values: DataFrame, registry: DataFrame, as_of, entities=None,
                  features=None, versions: str = "all", apply_ttl: bool = False,
                  columns=None) -> DataFrame:
    """Newest value with ``event_ts <= as_of`` per (entity, feature name).

    Versions of one name are pooled (as the reference does); ties on the
    timestamp go to the higher version, then the higher write_seq.  With
    ``apply_ttl`` a chosen value older than its definition's ttl is dropped
    (V4, off by default like the reference).  Inner: missing pairs are absent.
    ``columns`` narrows the carried payload (default: all of ``PAYLOAD``), so
    the scan reads only what the caller needs -- e.g. not the metadata JSON.
    """
    v = resolved_values(bound_upper(values, as_of), registry, features, versions, entities)
    keep = list(PAYLOAD if columns is None else dict.fromkeys(["event_ts", *columns]))
    payload = F.struct(*keep, "ttl_hours", "dtype")
    order = F.struct("event_ts", "feature_version", "write_seq")
    out = (v.groupBy("entity_id", "feature_name")
            .agg(F.max_by(payload, order).alias("r"))
            .select("entity_id", "feature_name", "r.*"))
    if apply_ttl:
        out = out.where(F.col("event_ts") >= add_hours(ts_lit(as_of), -F.col("ttl_hours")))
    return out


def with_freshness(df: DataFrame, as_of, ts_col: str = "event_ts") -> DataFrame:
    """Age of each value in seconds at ``as_of`` (recomputed on read)."""
    return df.withColumn("freshness_seconds", seconds_between(ts_lit(as_of), F.col(ts_col)))


def history(values: DataFrame, registry: DataFrame, entities, features, start, end) -> DataFrame:
    """All values of the features for the entities with
    ``start <= ts <= end`` (both inclusive), ordered by time.  ``entities``
    may be None (all), a list, or a DataFrame."""
    t0, t1 = ts_lit(start), ts_lit(end)
    v = values.where((F.col("event_ts") >= t0) & (F.col("event_ts") <= t1))
    if "dt" in values.columns:
        v = v.where((F.col("dt") >= F.to_date(t0)) & (F.col("dt") <= F.to_date(t1)))
    v = resolved_values(v, registry, features, "all", entities)
    return v.select("entity_id", "feature_name", "value_num", "value_json", "event_ts",
                    F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
                    "feature_version", "write_seq") \
        .orderBy("entity_id", "feature_name", "event_ts", "write_seq")


def to_feature_map(pit: DataFrame) -> DataFrame:
    """R2: one row per entity with ``features MAP<name, STRUCT<value, ts,
    metadata>>``; entities without values are absent.  The group per entity is
    bounded by the number of features (one row per feature after J2)."""
    entry = F.struct(F.col("feature_name"), F.struct(
        F.col("value_num").alias("value"), F.col("event_ts").alias("timestamp"),
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata")))
    return pit.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features"),
        F.count("*").alias("n_features"))


def render_feature_map(fmap: DataFrame) -> DataFrame:
    """``name=value;...`` in name order, for comparison and display."""
    entries = F.map_entries("features")
    text = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(
        e["key"], F.lit("="), F.format_string("%.2f", e["value"]["value"]))), ";")
    return fmap.select("entity_id", text.alias("feature_map"), "n_features")


def to_matrix(pit: DataFrame, features, value_col: str = "value_num") -> DataFrame:
    """One row per entity, one column per feature (explicit list, so the
    schema is static and no distinct pass over the data is needed)."""
    feats = list(features)
    return pit.groupBy("entity_id").pivot("feature_name", feats).agg(F.first(value_col))


def batch_retrieval(values: DataFrame, registry: DataFrame, requests: DataFrame,
                    max_entities: int | None = None) -> tuple[DataFrame, DataFrame]:
    """H2 over a table of batch requests ``(request_id, entity_ids ARRAY,
    feature_names ARRAY, as_of)``: V2 per request, then one J2 per
    (request, entity, feature) via the as-of join.

    Returns ``(answers, rejects)``.  Invalid requests are in ``rejects``; a
    valid request for which nothing was found has no rows in either.
    ``answers`` carries the number of entities of the request that have a
    value (A11); ``rejects`` the request with its violations."""
    from .asof import as_of_join_long
    from .quality import validate_requests

    checked = validate_requests(requests, max_entities)
    ok = checked.where("valid")
    spine = (ok.select("request_id", "as_of", F.explode(F.array_distinct("entity_ids")).alias("entity_id"),
                       "feature_names")
               .select("request_id", "as_of", "entity_id", F.explode(F.array_distinct("feature_names"))
                       .alias("feature_name")))
    hits = as_of_join_long(spine, values, registry, time="as_of").where("value_ts is not null and request_id is not null")
    # The entities are counted over the hits as they pass: a join with their count would do the as-of join twice.
    request = Window.partitionBy("request_id")
    nth = F.dense_rank().over(request.orderBy("entity_id")).cast("long")
    answers = hits.withColumn("_nth", nth).withColumn("entities_returned", F.max("_nth").over(request)).drop("_nth")
    return answers, checked.where("not valid").drop("valid")
